"""Column functions: text, numbers, units, arrays and model output."""
