"""The same questions over streams."""
