"""Append-only columnar archives and composable row queries on Spark."""
