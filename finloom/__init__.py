"""Document-retrieval analytics on Spark: parse, chunk, index, search, fuse, evaluate."""

__version__ = "0.1.0"
