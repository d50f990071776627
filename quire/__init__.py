"""quire: document-conversion analytics on PySpark."""
