"""Operators for building training corpora: joins, searches, models and encoders over documents.

Every module states what it does with nulls, empty and very long texts, repeated rows and empty tables.
"""
