"""Toxicity: subword-bag embeddings under a linear softmax, over runs of words.

Misspelt insults share character n-grams with the ones seen, so they land near them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellum.llm import subwords

#: A few words make a text toxic, so runs of words are scored, and the document takes its highest run.
SHAPE = subwords.Shape(bits=18, shortest=3, longest=6, fold_case=True, window=24, repeats=False)
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> subwords.Model:
    """A model of labels.toxic; see subwords.fit for the bounds."""
    return subwords.fit(docs, labels, "text", "doc_id", "toxic", SHAPE, max_rows=max_rows, epochs=6, rate=3.0, rounds=3)
