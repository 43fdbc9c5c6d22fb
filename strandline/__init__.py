"""strandline: a PySpark-native analytics library for at-least-once event capture and corpus building."""
