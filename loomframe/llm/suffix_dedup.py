"""Suffix-array dedup: byte strings that occur elsewhere, found by sorting suffixes.

Shards hold the segments that may share strings (see `repeats`), so each shard's
suffixes can be sorted by themselves: difference-cover sampling, names of sorted
triples, recursion where names repeat, a merge of the remaining suffixes, and a
comparison of adjacent suffixes' first bytes. Suffixes that agree with a
neighbour over the whole length repeat.

Texts are UTF-8 bytes. Defined results: null text is empty; a text shorter than
the length keeps all; overlapping repeats within a text count; copies of a text
remove each other whole; ids may be null or repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.repeats import Alphabet, Corpus, digest, removed, spans
from loomframe.llm.suffix_array import shared_prefixes, suffix_array

LENGTH, K = 200, 32


def shard(length: int):
    def resolve(payloads: list[bytes], only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in payloads])
        base = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.zeros((sizes + 1).sum(), np.int64)
        inner = np.ones(len(text), bool)
        inner[base + sizes] = False
        text[inner] = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64) + 1
        order = suffix_array(text)
        owner = np.repeat(np.arange(len(payloads)), sizes + 1)
        whole = order + length <= base[owner[order]] + sizes[owner[order]]
        starts = order[whole]  # suffixes with a whole string inside their segment
        same = shared_prefixes(text, starts, length)
        twice = starts[np.r_[same, False] | np.r_[False, same]]
        twice = twice[only[owner[twice]]]
        return owner[twice], twice - base[owner[twice]]

    return resolve


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame, Corpus]:
    """(id, digest) of every row; (digest, n, n_removed, spans, kept) of every distinct text; the written corpus, to drop when done."""
    alphabet = Alphabet(False, length, min(K, length))
    corpus = Corpus(docs.sparkSession, docs.select(F.col(text_col).alias("text")))
    found = corpus.keep(spans(corpus, alphabet, shard(length), shard_bytes=1 << 20), "spans")
    return docs.select(F.col(id_col), digest(F.col(text_col)).alias("digest")), removed(corpus, found, alphabet), corpus
