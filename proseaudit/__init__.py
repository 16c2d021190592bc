"""proseaudit: corpus-scale document style auditing as lazily composed Spark DataFrames.

Layers, from the bottom up:

``functions``  Column -> Column helpers (text classes, span rewriting, gates, validation).
``operators``  DataFrame -> DataFrame steps, usable with ``df.transform(...)``.
``sources``    schemas, readers, sinks.
``streaming``  the Structured Streaming forms of the same operators.
``plans``      whole jobs, and the registry of queries with their SQL twins.
"""

__version__ = "0.1.0"
