"""A PySpark engine for document corpora and study analytics."""
