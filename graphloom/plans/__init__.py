"""Plan helpers: table access, lineage cuts and bounded loops."""
