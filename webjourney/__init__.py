"""webjourney: PySpark-native analytics over web visits and interaction events."""
