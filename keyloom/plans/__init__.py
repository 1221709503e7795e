"""Planning helpers shared by the operators: size-checked broadcasts and lineage cuts."""
