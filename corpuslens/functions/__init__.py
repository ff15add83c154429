"""Column expressions: everything here stays inside one row and needs no shuffle."""
