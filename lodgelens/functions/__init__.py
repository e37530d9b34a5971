"""Column functions: every one takes and returns ``Column`` objects and stays inside generated code."""
