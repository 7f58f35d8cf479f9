"""DataFrame operators: each takes and returns DataFrames, batch unless noted."""
