"""The analyses on data that arrives bit by bit."""
