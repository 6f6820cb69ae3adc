"""Spatial operators: joins, aggregates, nearest neighbours, generated points."""

from .aggregates import collect_agg, extent_agg, intersection_agg, makeline_agg, union_agg
from .generate import generate_points
from .joins import bounds_of, knn_join, match_counts, spatial_join

__all__ = ["bounds_of", "collect_agg", "extent_agg", "generate_points", "intersection_agg", "knn_join", "makeline_agg", "match_counts", "spatial_join", "union_agg"]
