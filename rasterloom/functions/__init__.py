"""Column names and key-based random columns."""
