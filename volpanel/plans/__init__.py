"""Compositions of operators: end-to-end builds, experiments and the registered queries."""
