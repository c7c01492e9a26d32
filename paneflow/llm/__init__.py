"""Training-data operators: one module each, queries in :mod:`paneflow.llm.queries`."""
