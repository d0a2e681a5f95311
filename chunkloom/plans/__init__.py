"""Plan-level helpers: lineage cuts, size-checked broadcasts, pipelines."""
