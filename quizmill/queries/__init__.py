"""Queries by family; importing a module registers its queries."""
