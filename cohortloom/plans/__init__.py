"""Input builders for the given tables and the registered queries."""
