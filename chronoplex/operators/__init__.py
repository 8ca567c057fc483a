"""Graph, series and cross-over operators; each one is a DataFrame job."""
