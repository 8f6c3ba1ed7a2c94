"""Jobs, and the queries that are registered."""
