"""caseframe: a PySpark-native analytics engine for structured-extraction data."""
