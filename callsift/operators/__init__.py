"""DataFrame operators of the pipeline (joins, aggregations, windows, merges)."""
