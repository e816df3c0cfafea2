"""kinweave: record linkage and table-scale query operators on Spark DataFrames."""

__all__ = ["__version__"]
__version__ = "0.1.0"
