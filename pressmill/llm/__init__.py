"""Training-data operators: token counts, de-duplication, sharding, search, packing and the like."""
