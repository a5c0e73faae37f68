"""Training-data operators: scoring, de-duplication, mixing, sharding and packing of text documents.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is there.
"""
