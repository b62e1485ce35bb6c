"""Voxelith: scene point clouds, vector search and their data model as Spark DataFrames."""

__version__ = "0.1.0"
