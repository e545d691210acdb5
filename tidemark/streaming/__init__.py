"""Windows over streams."""
