"""Column functions on ids, similarities and output lines."""
