"""Where rows come from: Parquet outside, versioned tables inside."""
