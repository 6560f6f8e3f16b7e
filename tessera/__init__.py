"""tessera: retrieval, evaluation, curation and training-data operators as Spark plans."""
