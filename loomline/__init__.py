"""Timeline analytics on Spark: interval joins, gaps-and-islands, signals, metadata merging and streams as DataFrame operators."""
