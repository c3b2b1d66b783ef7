"""meterline: a PySpark-native analytics engine for assistant usage telemetry."""
