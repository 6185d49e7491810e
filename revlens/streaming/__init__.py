"""Reports kept up to date on append-only feeds."""
