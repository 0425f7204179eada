"""Reading and writing in-force tables and cohort summaries."""
