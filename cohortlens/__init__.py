"""Health-survey analytics on Spark: clean, report, aggregate, score, evaluate."""
