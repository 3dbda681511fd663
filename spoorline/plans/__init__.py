"""Tasks over the tables at hand, and the registry of queries."""
