"""The analyses and their summaries, each a function from DataFrame to DataFrame."""
