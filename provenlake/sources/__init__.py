"""Sources: note trees, code trees, symbol graphs, anchor logs, tool manifests, skill files."""
