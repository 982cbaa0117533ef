"""Queries over the driver tables: fixtures, plans and the SQL that checks them."""

from solarweave.plans import catalogue, detections, layouts, polygons, rasters, surfaces

#: Each has QUERIES and SQL by name.
MODULES = [layouts, detections, polygons, rasters, surfaces, catalogue]
