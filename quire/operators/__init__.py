"""Operators on pages, lines, tables, boxes and packages."""
