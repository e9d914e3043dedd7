"""formlens: a PySpark-native analytics engine for form-document products."""
