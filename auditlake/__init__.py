"""Site-audit analytics on Spark: crawl corpora and measurement logs in, ranked findings out."""
