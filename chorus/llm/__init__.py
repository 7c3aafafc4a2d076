"""Training-data operators: packing, mixing, toxicity, sharding, near-duplicates, licences, top-k,
repeated passages and training order.

Each operator is ``f(DataFrame, **params) -> DataFrame`` over a table with an id column and a text
(or vector) column; other columns are ignored unless the docstring says otherwise, so clashing names
cannot disturb it.  ``queries.py`` holds the thin contract queries.  Nothing outside this subpackage
imports it.
"""
