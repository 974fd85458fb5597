"""Evidence retrieval and decision analytics over document corpora, as Spark jobs."""
