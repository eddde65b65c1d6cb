"""Operators for preparing training data: near-duplicates, licences, language,
packing, scoring, decontamination, nearest neighbours and token counts.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and
``__spark_entry__.py`` are its only users.
"""
