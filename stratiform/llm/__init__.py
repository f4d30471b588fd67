"""Training-data operators: packing, dedup, quality, decontamination, tokens, PII, chat.

Nothing outside this subpackage imports it, so it can be removed as a whole.
Each module keeps a general operator (texts, spans, files) and `queries.py`
derives the digest columns of the registered queries from it.
"""
