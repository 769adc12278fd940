"""Column builders that the operators share."""
