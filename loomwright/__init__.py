"""A PySpark-native analytics engine for tables of ordinary columns, text, JSON and vectors."""
