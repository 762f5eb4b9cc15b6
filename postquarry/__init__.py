"""Mail-archive analytics on PySpark: readers, normalisation, search index, views and change detection."""
