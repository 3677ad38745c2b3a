"""Analytics on paired microscopy image tiles, as Spark jobs."""
