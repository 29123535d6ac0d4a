"""trailspark: analytics over append-only interaction logs, built on Spark DataFrames."""

__version__ = "0.1.0"
