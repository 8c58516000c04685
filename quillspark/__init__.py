"""quillspark: Spark-first analytics over scholarly evidence and reference collections."""

__version__ = "0.1.0"
