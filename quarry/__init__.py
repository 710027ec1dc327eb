"""Literature analytics on PySpark: declarative operators over documents, records and flags."""
