"""Operators for large training-data pipelines (dedup, filters, models, packing).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
