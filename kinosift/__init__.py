"""kinosift: a Spark-first engine for ranked moment retrieval over frame embeddings."""
