"""Reading tables, uploaded files and key-value style lookups."""
