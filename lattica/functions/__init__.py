"""See the package docstring of lattica."""
