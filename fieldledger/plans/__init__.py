"""Ready-made plans: inputs derived from the relational tables, and the query catalogue."""
