"""quern: knowledge-corpus analytics expressed as Spark DataFrame and SQL plans."""
