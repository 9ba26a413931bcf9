"""Column helpers and distributed building blocks shared by the operators."""
