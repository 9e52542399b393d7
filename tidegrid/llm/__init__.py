"""Training-text operators. Nothing outside this package imports it."""
