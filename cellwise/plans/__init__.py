"""Report views over the driver's tables, registered queries and their DuckDB counterparts."""
