"""Quern: typed, versioned record collections on Spark.

A collection is an append-only log of mutations; its state, its change feed and its
indexes are DataFrame expressions over that log.
"""
