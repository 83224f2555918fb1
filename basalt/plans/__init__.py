"""Plan plumbing that is not tied to one operator: lineage cuts and shipping code to executors."""
