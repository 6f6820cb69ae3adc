"""Readers and writers of geospatial formats.

``st_read(spark, path, ...)`` picks the reader by the file's name. Formats: GeoJSON,
newline-delimited GeoJSON, ESRI shapefile, GeoPackage, OpenStreetMap PBF, CSV with WKT,
Parquet with WKB."""

from .dispatch import DRIVERS, register, st_drivers, st_list_proj_crs, st_read, st_read_meta, st_write

__all__ = ["DRIVERS", "register", "st_drivers", "st_list_proj_crs", "st_read", "st_read_meta", "st_write"]
