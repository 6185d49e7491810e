"""Relational building blocks over a ChangeLog."""
