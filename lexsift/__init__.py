"""Text search and index analytics over tables of documents, on Spark."""
