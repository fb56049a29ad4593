"""Query operators with semantics of their own."""
