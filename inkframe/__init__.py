"""Analytics over bilevel rasters, glyphs and their codings, on Spark."""

__version__ = "0.1.0"
