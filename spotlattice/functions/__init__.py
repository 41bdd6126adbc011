"""Functions of the spatial copy-number engine."""
