"""tracemill: a Spark-native engine for profiling data (events, heaps, stack samples)."""
