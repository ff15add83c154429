"""Reading pairs, bringing their columns to one schema, and writing results."""
