"""typelens: a PySpark-native analytics library for a type-design catalogue."""
