"""Column expressions: text cleaning, timestamps, masks, variables, display."""
