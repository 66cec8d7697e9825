"""The consequences of single changes, kept up to date over streams."""
