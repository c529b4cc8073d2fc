"""Column builders and statistics shared by the jobs."""
