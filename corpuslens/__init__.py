"""corpuslens: analyses of prompt/response corpora as Spark DataFrame jobs."""
