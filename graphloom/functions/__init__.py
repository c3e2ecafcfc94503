"""Functions of the graph engine."""
