"""Training-data operators: near-duplicates, scans, classifiers, archives, tokens.

Nothing else in the library imports this subpackage. ``QUERIES`` and ``ORACLE_SQL``
hold what ``__spark_entry__.py`` registers.
"""
