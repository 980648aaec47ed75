"""Usage analytics on Spark: sources, pricing, reconciliation and reports as DataFrame programs."""
