"""Training-data operators: filters, search, token counts, dedup, mixing, packing, WARC."""
