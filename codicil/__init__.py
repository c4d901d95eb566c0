"""Codicil: Spark jobs for versioned legal-style corpora.

Sub-packages: ``sources`` (tables in and out), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``streaming`` (Structured
Streaming jobs) and ``plans`` (registered queries with their reference SQL).
"""
