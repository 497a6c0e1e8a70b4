"""Road tables from their sources."""
