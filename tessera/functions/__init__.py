"""Column functions: pure Column -> Column, no actions, no Python on rows."""
