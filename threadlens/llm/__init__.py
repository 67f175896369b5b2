"""Training-data operators: deduplication, quality, packing, secrets, language and archive work.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries when it is present.
"""
