"""Physical helpers shared by the operators: lineage cuts and hot-key handling."""
