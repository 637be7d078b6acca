"""Training-data operators: token counts, packing, media, privacy, deduplication, search, tokenizer
round trips, language, quality and sharding.  Nothing outside this subpackage imports it."""
