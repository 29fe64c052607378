"""Column builders: each takes Columns and returns a Column, no shuffle, no Python workers."""
