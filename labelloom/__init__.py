"""labelloom: label curation and two-level text classification as Spark jobs."""

__version__ = "0.1.0"
