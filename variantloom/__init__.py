"""variantloom: rare-variant association and meta-analysis as Spark jobs."""
