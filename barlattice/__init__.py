"""Market-wide equity screening, and the preparation of training text, on PySpark."""
