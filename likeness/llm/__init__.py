"""Operators of a training-data pipeline: one module each, and their queries.

Each module documents its method, its parameters and what it does with nulls, empty
and very long texts, ties, repeated rows and empty tables. Nothing outside this
package imports it.
"""
