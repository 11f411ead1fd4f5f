"""quillgate: an evidence-ledger analytics engine expressed in PySpark DataFrames."""
