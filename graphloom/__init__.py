"""graphloom: property-graph analytics over code, history and traces, on Spark DataFrames."""

__version__ = "0.1.0"
