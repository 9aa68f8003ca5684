"""PySpark-native analytics of coastal evidence."""
