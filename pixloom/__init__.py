"""Spark-first operators for cleaning and organising large media exports."""
