"""PySpark-native entity-record and ranking analytics."""
