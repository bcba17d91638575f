"""Graph algorithms and graph operations; every one takes a Graph and returns DataFrames."""
