"""Tidepool: a Spark-native analytics engine for pooled social-post captures."""
