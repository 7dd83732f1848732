"""Column functions: the epidemiological calendar, sums, and quantiles."""
