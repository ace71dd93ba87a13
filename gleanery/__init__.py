"""Evidence mining over text corpora, written as Spark DataFrame jobs."""
