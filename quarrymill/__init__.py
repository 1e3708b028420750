"""Retrieval and knowledge-graph analytics over whole tables of documents, vectors, queries and graphs, as Spark plans."""
