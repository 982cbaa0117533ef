"""Distributed operators on roofs, detections, rasters, datasets and metrics."""
