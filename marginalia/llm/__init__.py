"""Operators that prepare text corpora for the training of language models.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if it is present.
"""
