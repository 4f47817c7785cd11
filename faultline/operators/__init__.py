"""DataFrame operators: joins, windows, grouped aggregates."""
