"""geoloom: a PySpark-native engine for map, place and transit analytics."""
