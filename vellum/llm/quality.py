"""Quality classifier: supervised subword embeddings averaged per document under a softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vellum.llm import subwords

SHAPE = subwords.Shape(bits=18, shortest=3, longest=5, fold_case=False, pairs=True)
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> subwords.Model:
    """A model of labels.quality; see subwords.fit for the bounds."""
    return subwords.fit(docs, labels, "text", "doc_id", "quality", SHAPE, max_rows=max_rows, epochs=12, rate=24.0)
