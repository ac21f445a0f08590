"""Factor columns, named recipes and transforms."""
