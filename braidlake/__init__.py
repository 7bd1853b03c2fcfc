"""braidlake: declarative entity queries over lake tables, compiled to Spark plans."""

__version__ = "0.1.0"
