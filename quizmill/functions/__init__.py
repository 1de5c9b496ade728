"""Column functions with the platform's scalar semantics."""
