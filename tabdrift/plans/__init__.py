"""Whole diffs as declarative plans over cells, objects and documents."""
