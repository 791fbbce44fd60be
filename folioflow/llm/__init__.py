"""Operators for training-data pipelines: packing, tokenizers, language, quality, duplicates, sharding, token counts."""
