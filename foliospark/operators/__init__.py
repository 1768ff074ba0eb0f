"""operators of foliospark."""
