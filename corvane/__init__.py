"""corvane: corpus evaluation and corpus construction on PySpark DataFrames."""

__version__ = "0.1.0"
