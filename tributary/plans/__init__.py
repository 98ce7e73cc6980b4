"""Iterative plans: reachability, connected sets, and how their lineage is cut."""
