"""Retail analytics on PySpark: reports, listings, batch table changes, page previews, streams."""
