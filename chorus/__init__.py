"""chorus — social post analytics as Spark DataFrame operators.

Posts (``chorus.schema.POST_SCHEMA``) go in, DataFrames come out:

* ``chorus.sources``   — landed JSON (tweets, submissions, listings, comments), fixtures
* ``chorus.functions`` — column expressions (text normalisation, labels, formatting)
* ``chorus.operators`` — projections, filters, dedup, sentiment, aggregates, series, graphs, keywords
* ``chorus.plans``     — whole analyses (``analyze_posts``), exports and the query catalog
* ``chorus.streaming`` — the incremental (stateful) variants
"""

__version__ = "0.1.0"
