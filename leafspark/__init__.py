"""A PySpark engine for corpora of PDF documents."""
