"""Streaming entry points.

The reference's analyses are batch queries over loaded tables; it has no
streams, windows over event time or stateful operators. The one step that
recurs is importing new CSV exports into the tables, which
:mod:`souk.streaming.ingest` runs as an incremental Structured Streaming load.
"""
