"""rwspark: read/write-policy data construction and analytics on PySpark."""
