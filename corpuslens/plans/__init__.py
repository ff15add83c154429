"""Choices about physical plans: joins against small tables, cut points, scan spread."""
