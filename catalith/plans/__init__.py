"""Driver queries over the synthetic tables and their SQL."""
