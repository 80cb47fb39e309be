"""Relational operators on graphs, records and documents."""
