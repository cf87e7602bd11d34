"""Column-level building blocks: hashing, exact ranking, text and vector expressions."""
