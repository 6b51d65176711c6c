"""Column builders: scalar helpers and windowed indicators."""
