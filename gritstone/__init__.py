"""gritstone: a PySpark-native engine for software-project activity data."""
