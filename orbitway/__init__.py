"""Loop-route analytics on Spark: road graphs, tariffs and set-based loop search as DataFrames."""
