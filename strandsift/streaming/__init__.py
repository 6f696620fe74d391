"""Search over streams."""
