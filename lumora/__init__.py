"""Catalogue analytics on Spark: paging, search, clustering, ingest and feeds over DataFrames."""
