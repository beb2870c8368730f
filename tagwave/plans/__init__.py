"""Plans: distributed scans, the query catalog and the oracle texts."""
