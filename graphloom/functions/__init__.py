"""Column functions: term construction, display, order and filter conditions."""
