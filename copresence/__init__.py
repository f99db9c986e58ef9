"""Spark-native co-location analytics: location pings in, co-presence facts out."""
