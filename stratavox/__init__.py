"""A PySpark-native engine for volume data, spatial transforms and their quality control."""
