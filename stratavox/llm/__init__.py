"""Training-data operators: filters, deduplication, mixing, packing, archives and search on Spark."""
