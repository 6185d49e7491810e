"""Reports: end-to-end queries over a change log."""
