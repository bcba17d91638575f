"""Plan helpers shared by the operators: lineage cuts and the superstep loop."""
