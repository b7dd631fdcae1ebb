"""Raster analytics on PySpark: images as pixel tables, operators as DataFrame transformations."""
