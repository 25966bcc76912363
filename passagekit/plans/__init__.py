"""End-to-end jobs (corpus build, index build, retrieval) and the query
registry used by ``__spark_entry__``."""
