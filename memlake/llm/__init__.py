"""Training-data operators: joins, scans, classifiers, shards, formats and codecs for text corpora.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; the modules
state what they do with nulls, empty texts, repeated rows, empty tables and extra columns.
"""
