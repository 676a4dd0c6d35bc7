"""PySpark-native record analytics."""
