"""longctx: a Spark-native engine for context-dilution evaluation.

Every operator is a DataFrame -> DataFrame function; plans compose them.
"""

__version__ = "0.1.0"
