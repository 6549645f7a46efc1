"""Document analytics on Spark: pages, layout regions, recognition, assembly and caching as DataFrame plans."""
