"""keyloom: typed key/value dictionaries and flattened JSON documents as Spark DataFrames."""

__version__ = "0.1.0"
