"""A Spark-first engine for curating, searching and measuring document corpora."""
