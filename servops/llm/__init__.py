"""Corpus preparation for language-model training: sharding, token counts, page extraction,
near-duplicate search, language ID, source mixing, line dedup, benchmark decontamination,
license scans, document fingerprints, centroid clustering, spelling variants and near-duplicate vectors.

Nothing else in the library imports this subpackage.
"""
