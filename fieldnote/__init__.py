"""fieldnote: turn large collections of public posts into countable, checkable evidence on Spark."""

__version__ = "0.1.0"
