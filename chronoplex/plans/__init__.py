"""Multi-step plans: positions in skewed groups, fixpoint loops, lineage cuts."""
