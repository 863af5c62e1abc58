"""Plans over the driver's tables: the pseudo-scan, the queries, and their SQL."""
