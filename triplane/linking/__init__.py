"""Names in questions linked to the nodes of a graph."""
