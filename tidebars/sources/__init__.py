"""Reading and writing bar tables."""
