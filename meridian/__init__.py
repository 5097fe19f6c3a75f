"""Spark-native market-event analytics."""
