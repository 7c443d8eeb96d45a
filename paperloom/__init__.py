"""paperloom: document-processing analytics on PySpark DataFrames."""
