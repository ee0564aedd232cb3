"""Multi-operator stages and the query registry."""
