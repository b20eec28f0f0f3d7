"""Spark-first analytics over observability data: metrics, traces, logs and their rollups."""
