"""From a building file to placed sensors."""
