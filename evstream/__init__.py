"""PySpark-native analytics for event-camera streams."""
