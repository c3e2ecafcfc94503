"""Plans of the graph engine."""
