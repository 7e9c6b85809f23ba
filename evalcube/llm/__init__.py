"""Operators of a training-data pipeline (dedup, archives, quality, packing, language, mixing, chat).

Each module holds one operator with its own interface; ``queries_llm`` applies
them to the given tables. Nothing outside this package imports it.
"""
