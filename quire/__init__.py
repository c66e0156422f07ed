"""quire: positioned text to an analysable document model, on PySpark."""
