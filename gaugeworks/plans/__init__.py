"""The query registry and the SQL that must agree with it."""
