"""tidemark: a small relational analytics engine expressed in Spark plans."""
