"""Readers, stacked tables, annotation lookups and the views on the test tables."""
