"""Spark jobs for point clouds, the graphs built on them, and their segmentation metrics."""
