"""corpusloom: web-corpus processing and lexical retrieval as Spark DataFrame operators."""
