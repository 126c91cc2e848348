"""Search, browsing, versions and curation of notes as Spark DataFrames."""

__version__ = "0.3.0"
