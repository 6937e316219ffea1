"""File formats at the edges: CSV with spans, OOXML parts; Python helpers inside partitioned jobs."""
