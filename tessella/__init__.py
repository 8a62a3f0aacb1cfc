"""Data curation and integration on PySpark: schema mapping, matching, clustering and learning over a cell model."""
