"""Tidemill: a Spark-native engine for streams, tables, files and text.

Everything is a logical plan over DataFrames; Catalyst and Tungsten choose the
physical one.  Nothing outside ``tidemill.llm`` imports ``tidemill.llm``.
"""
