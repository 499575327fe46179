"""Folio: document collections as Spark tables, from raw pages to ranked search."""
