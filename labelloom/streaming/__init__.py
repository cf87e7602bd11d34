"""The same row-wise operators on Structured Streaming file sources."""
