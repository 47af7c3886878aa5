"""Scene headers, readers and writers."""
