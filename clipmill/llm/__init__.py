"""Operators of a training-data pipeline: filter, deduplicate, decontaminate, mix and shard documents.

One module per operator; `queries` registers one query for each over the given tables.
"""
