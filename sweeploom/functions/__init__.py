"""See README.md for the contents of this package."""
