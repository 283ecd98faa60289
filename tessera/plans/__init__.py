"""Whole queries: the steps of retrieval and answering put together."""
