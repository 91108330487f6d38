"""tidemark: catalog, profiling, dictionary, retrieval and query-log operators on Spark DataFrames."""

__version__ = "0.1.0"
