"""Training-data operators: toxicity, packing, de-duplication, search, tokenising and quality."""
