"""Substring dedup: windows of words that occur elsewhere, found with compressed FM-indexes.

A shard holds the segments of its keys. Their words become symbols, and an
FM-index with a wavelet matrix is built over them. The segments are then streamed
through it, all at once: backward search gives matching statistics (the longest
stretch up to each end that occurs twice or more), and the intervals of at least
a window's length are reported.
See `repeats` for how segments reach their shard and what happens around it.

Words are runs other than space and bytes 9 to 13, unchanged. Defined results:
null or wordless text has no words and nothing removed; a text shorter than a
window keeps all; overlapping repeats within a text count; copies of a text
remove each other whole; ids may be null or repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.fm_index import FMIndex
from loomframe.llm.repeats import Alphabet, Corpus, digest, removed, spans

WINDOW, K = 35, 8


def shard(window: int):
    def resolve(payloads: list[bytes], only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vocabulary: dict[bytes, int] = {}
        sequences = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in p.split(b" ")], np.int64) for p in payloads]
        if not only.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        index = FMIndex(sequences, len(vocabulary))
        sizes = np.array([len(s) for s in sequences])
        asked = np.flatnonzero(only)
        which, start, end = index.intervals(np.concatenate(sequences), (np.cumsum(sizes) - sizes)[asked], sizes[asked], window)
        counts = end - start - window + 1
        return np.repeat(asked[which], counts), np.repeat(start - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())

    return resolve


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, Corpus]:
    """(id, digest) of every row; (digest, n, n_removed, spans, kept) of every distinct text; the written corpus, to drop when done."""
    alphabet = Alphabet(True, window, min(K, window))
    corpus = Corpus(docs.sparkSession, docs.select(F.col(text_col).alias("text")))
    found = corpus.keep(spans(corpus, alphabet, shard(window)), "spans")
    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest")), removed(corpus, found, alphabet), corpus
