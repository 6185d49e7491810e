"""Text, JSON and series output."""
