"""A PySpark-native engine for media catalogs: search, tags, folders, duplicates, merge and rename planning."""
