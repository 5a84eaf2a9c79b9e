"""weftline: a PySpark-native engine for typed vectors, link graphs and text fields.

Sub-packages
------------
``sources``    readers and writers (store directory, link files, text dump)
``functions``  scalar building blocks (bit vectors, vectors, compressed bitmaps)
``operators``  relational operators (search, page weight, references, skew, hierarchy, lexer)
``plans``      the query catalogue and its DuckDB counterparts
``streaming``  Structured Streaming ingest
"""

__version__ = "0.1.0"
