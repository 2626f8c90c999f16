"""DataFrame operators over associations, graphs, targets, molecules and proteins."""
