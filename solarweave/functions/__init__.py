"""Column functions shared by the operators."""
