"""Training-data operators: scoring, packing, deduplication, search, labelling and binary output."""
