"""Column functions, by the kind of value they work on."""
