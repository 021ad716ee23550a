"""geotables: tables of lon/lat geometries on Spark DataFrames.

Sub-packages:
  functions  column expressions (geohash cells, shapes, WKT, JSON tags)
  operators  DataFrame operators (range query, spatial join, overlay, prefix scans, ring checks)
  sources    readers and writers (WKT text, Parquet key table, WKB)
  plans      whole jobs, generated fixtures and the query catalog
  streaming  the stateless operators on streaming DataFrames
"""

from geotables.session import get_spark, storage_root

__all__ = ["get_spark", "storage_root"]
