"""stepweave: a PySpark-native engine for action sequences, nested records and training-data tables."""
