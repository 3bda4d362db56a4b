"""Source-code intelligence over Python projects, on Spark."""
