"""Analytics over corpora of code changes and other before/after text pairs,
expressed as Spark DataFrame and Structured Streaming jobs."""
