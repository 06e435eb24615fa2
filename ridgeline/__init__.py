"""ridgeline: a Spark-first analytics engine for large libraries of dated,
sparsely located and partly annotated items."""

__version__ = "0.1.0"
