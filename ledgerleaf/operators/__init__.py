"""Relational operators over pages, rows, cells and what is derived from them."""
