"""Data-selection analytics for object detection on Spark."""
