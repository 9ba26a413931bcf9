"""DataFrame-in, DataFrame-out table jobs."""
