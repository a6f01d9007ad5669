"""lakeloom: a PySpark-native typed query, record and data-preparation engine."""
