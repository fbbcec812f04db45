"""Benchmark decontamination: a BM25 index of test items, searched with block-max WAND.

Documents are cut into passages of 2 L words, one every L (L: words of the
longest item in the index), so that any item lies whole in some passage. Each
passage is a query against the items; an item's score is BM25 over the passage's
distinct words divided by the score of the item itself, and every item at or
over `threshold` is retrieved: block-max WAND skips items whose upper bound
stays under it. A retrieved item counts as leaked if its question and its
answer (all but its last sentence, and that) together share `overlap` of their
five-word shingles with the document, and each part shares half of its own.

The index goes out in blocks of `block_items` items, so what is broadcast is
bounded; document frequencies cover all items. Documents are read once for each
block, and nothing is shuffled but the result.

Defined results: null or wordless texts of documents or items match nothing;
items shorter than five words are compared as one shingle; repeated items are
indexed once and reported under each of their ids; repeated documents are
reported each; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B, SHINGLE, POSTINGS, COARSE = 1.2, 0.75, 5, 16, 64
WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"(?<=[.!?])\s+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(seq: list) -> set[tuple]:
    return {tuple(seq[i : i + SHINGLE]) for i in range(max(1, len(seq) - SHINGLE + 1))} if seq else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer, its last sentence with a word; one sentence is all question."""
    said = [w for w in map(words, SENTENCE.split(text)) if w]
    return ([w for s in said[:-1] for w in s], said[-1]) if len(said) > 1 else (said[0] if said else [], [])


@dataclass
class Index:
    """Postings in item order: for each term its items, its impacts (shares of the item's own score) and their maxima by block."""

    terms: dict[str, int]
    items: list[np.ndarray]
    impacts: list[np.ndarray]
    block_max: list[np.ndarray]
    top: np.ndarray
    coarse: np.ndarray  # maxima of each term over COARSE stretches of items, for all passages of a text at once
    texts: list[str]
    longest: int

    @staticmethod
    def build(texts: list[str], df: dict[str, int], total: int, mean: float) -> Index:
        terms: dict[str, int] = {}
        post: defaultdict[int, list[tuple[int, float]]] = defaultdict(list)
        longest = 1
        for i, text in enumerate(texts):
            seq = words(text)
            longest = max(longest, len(seq))
            tf: defaultdict[str, int] = defaultdict(int)
            for w in seq:
                tf[w] += 1
            weight = {w: np.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(seq) / mean)) for w, n in tf.items()}
            own = sum(weight.values())
            for w, x in weight.items():
                post[terms.setdefault(w, len(terms))].append((i, x / own))
        items = [np.array([i for i, _ in post[t]], np.int64) for t in range(len(terms))]
        impacts = [np.array([x for _, x in post[t]]) for t in range(len(terms))]
        maxima = [np.maximum.reduceat(x, np.arange(0, len(x), POSTINGS)) for x in impacts]
        coarse = np.zeros((len(terms), min(COARSE, -(-len(texts) // 4))), np.float32)
        for t in range(len(terms)):
            np.maximum.at(coarse[t], items[t] * coarse.shape[1] // len(texts), impacts[t])
        return Index(terms, items, impacts, maxima, np.array([x.max() for x in impacts]), coarse, texts, longest)

    def search(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score over the distinct terms of `query` reaches `threshold`: block-max WAND."""
        lists = [[int(self.items[t][0]), 0, t] for t in query]
        found, end = [], 1 << 60
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= threshold - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            near, following = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for _, at, t in lists[: pivot + 1]:
                at += int(np.searchsorted(self.items[t][at:], item))
                if at < len(self.items[t]):
                    near += self.block_max[t][at // POSTINGS]
                    last = min((at // POSTINGS + 1) * POSTINGS, len(self.items[t])) - 1
                    following = min(following, int(self.items[t][last]) + 1)
            if near < threshold - 1e-9:
                goal = max(following, item + 1)  # no item before it can reach the threshold
            elif lists[0][0] == item:
                score = sum(self.impacts[t][at] for _, at, t in lists[: pivot + 1])
                if score >= threshold - 1e-9:
                    found.append((item, float(score)))
                goal = item + 1
            else:
                goal = item
            for x in lists[: pivot + 1]:
                if x[0] < goal:
                    x[1] += int(np.searchsorted(self.items[x[2]][x[1] :], goal))
                    x[0] = int(self.items[x[2]][x[1]]) if x[1] < len(self.items[x[2]]) else end
            lists = [x for x in lists if x[0] < end]
        return found

    def passages(self, seq: list[str], threshold: float) -> Iterator[list[int]]:
        """Term lists of the passages whose terms' block maxima add up to the threshold in some coarse block of items."""
        get = self.terms.get
        ids = np.array([get(w, -1) for w in seq], np.int64)
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return
        n = len(self.terms)
        pairs = np.unique(at // self.longest * n + ids[at])
        stretch, term = np.divmod(pairs, n)
        first = np.flatnonzero(np.r_[True, stretch[1:] != stretch[:-1]])
        sums = np.zeros((len(seq) // self.longest + 2, self.coarse.shape[1]), np.float32)
        sums[stretch[first]] = np.add.reduceat(self.coarse[term], first, axis=0)
        for k in np.flatnonzero((sums[:-1] + sums[1:]).max(axis=1) >= threshold - 1e-4):
            terms = np.unique(term[np.searchsorted(stretch, k) : np.searchsorted(stretch, k + 2)])
            if self.coarse[terms].sum(axis=0).max() >= threshold - 1e-4:
                yield terms.tolist()

    def leaks(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float]]:
        """(item, best score, shingles shared) of the items that `text` leaks."""
        seq, best = words(text), {}
        for terms in self.passages(seq, threshold):
            for item, score in self.search(terms, threshold):
                best[item] = max(score, best.get(item, 0.0))
        if not best:
            return []
        has, out = shingles(seq), []
        for item, score in sorted(best.items()):
            question, answer = parts(self.texts[item])
            whole = shingles(question + answer) if len(question + answer) >= SHINGLE else {tuple(question + answer)}
            own = has if len(question + answer) >= SHINGLE else {tuple(seq[i : i + len(question + answer)]) for i in range(len(seq))}
            share = len(whole & own) / len(whole)
            halves = all(len(p) < SHINGLE or len(shingles(p) & has) >= 0.5 * len(shingles(p)) for p in (question, answer))
            if share >= overlap and halves:
                out.append((item, score, share))
        return out


def indexes(bench: DataFrame, text_col: str, block_items: int) -> Iterator[Index]:
    """Indexes of blocks of the distinct item texts, with statistics of all."""
    items = bench.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
    tokens = items.select("text", F.expr(r"regexp_extract_all(lower(text), '(?U)\\w+', 0)").alias("w"))
    total, mean = tokens.select(F.count("*"), F.avg(F.size("w"))).first()
    if not total or not mean:
        return
    df = tokens.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    blocks = -(-total // block_items)
    placed = tokens.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    for block in range(blocks):
        mine = placed.filter(F.col("block") == block)
        texts = sorted(r.text for r in mine.select("text").collect())
        used = mine.select(F.explode(F.array_distinct("w")).alias("w")).distinct()
        counts = defaultdict(lambda: 1, {r.w: r.n for r in df.join(used, "w").collect()})
        texts = [t for t in texts if words(t)]
        if texts:
            yield Index.build(texts, counts, total, mean)


def leaked(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.8, block_items: int = 20000) -> DataFrame:
    """(doc_id, item_id, score, overlap): one row for each document and item that it leaks."""
    spark = docs.sparkSession
    rows, kind = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, item_text string, score double, overlap double"
    found = spark.createDataFrame([], schema)
    for index in indexes(bench, item_text, block_items):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                hits = [(d, sent.value.texts[i], s, o) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i, s, o in sent.value.leaks(t, threshold, overlap)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_text", "score", "overlap"])

        found = found.unionByName(rows.mapInPandas(search, schema))
    ids = bench.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("item_text"))
    return found.join(ids, "item_text").select("doc_id", "item_id", "score", "overlap")


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.8, block_items: int = 20000) -> DataFrame:
    """`docs` without those that leak an item: a filter on each index in turn, without a shuffle."""
    for index in indexes(bench, item_text, block_items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        docs = docs.filter(~leak_test(sent, threshold, overlap)(F.col(text_col)))
    return docs


def leak_test(sent, threshold: float, overlap: float):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(sent.value.leaks(t, threshold, overlap)) for t in texts], dtype=bool)

    return hit
