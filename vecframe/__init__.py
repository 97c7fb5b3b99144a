"""PySpark-native long-vector analytics."""
