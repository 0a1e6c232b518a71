"""Training-data operators over `documents`, `benchmark`, `labels`, `conversations` and `embeddings`.

Nothing outside this package imports it; the registered queries are in `queries`.
"""
