"""Column helpers shared by the operator families."""
