"""Scalar functions as Column expressions; everything stays in the JVM."""

from corvane.functions.hashing import bucket, fnv1a, normalize, split_of
from corvane.functions.text import bigrams, ngrams, tokens

__all__ = ["bigrams", "bucket", "fnv1a", "ngrams", "normalize", "split_of", "tokens"]
