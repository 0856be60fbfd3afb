"""barloom: panel analytics over bars and news, written as Spark DataFrame plans."""

__version__ = "0.1.0"
