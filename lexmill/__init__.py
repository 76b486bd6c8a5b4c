"""lexmill: a PySpark-native engine for morphology and corpus statistics."""
