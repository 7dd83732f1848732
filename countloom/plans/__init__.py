"""Jobs of several operators, and the queries that run each operator on the tables."""
