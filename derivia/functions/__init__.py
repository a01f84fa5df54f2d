"""Column functions: the derivation kernel and the column rules."""
