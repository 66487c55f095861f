"""Column-valued building blocks shared by the operators."""
