"""Where readings and topology come from."""
