"""Operators for training-data pipelines: secrets, page extraction, packing,
chat formatting, quality rules, decontamination, token counts, near-duplicate
joins, web archives, line dedup, source divergence, quality classification and phrase
collocations. Nothing else in the library imports this
package."""
