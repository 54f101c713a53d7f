"""Payment-stream analytics on Spark: decode, fold, value, query, report."""
