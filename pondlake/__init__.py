"""Spark-native analytics for pond-sensor time series.

Subpackages:
  sources    -- CSV ingest, conforming, catalog tables, sinks
  functions  -- column-level expressions (parsing, casting, formatting)
  operators  -- DataFrame -> DataFrame operators (series, cross-pond, drift, learning)
  plans      -- end-to-end compositions (monitor, dashboard, training, ingest)
  streaming  -- Structured Streaming ingest and refresh jobs
"""

__version__ = "0.1.0"
