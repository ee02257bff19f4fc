"""Operators for building language-model training data: one module per operator.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
