"""Statement summaries, plan services and the query catalogue."""
