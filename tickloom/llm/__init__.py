"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it.  Every operator is a function of DataFrames; work is
dealt out by Spark, and what must cross between jobs is written to the shared checkpoint folder.
"""
