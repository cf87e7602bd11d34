"""End-to-end flows composed from operators, and the query catalogue."""
