"""quillon: a PySpark-native select-project-join engine with a small SQL dialect."""
