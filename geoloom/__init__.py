"""Spark-first analysis of geometric collections: meshes, polygons, points, voxels and rasters as DataFrames."""
