"""Whole plans: registered queries, the archive, tables between steps."""
