"""Where change logs come from."""
