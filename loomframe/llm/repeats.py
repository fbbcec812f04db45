"""Repeated windows of a corpus: the part that substring and suffix-array dedup share.

1. Texts meet by digest; each distinct one is written once, bucketed by digest,
   with the number of its copies. Later steps move only narrow rows to it.
2. Each text's segments (see `segments`) become rows (key, content digest, text,
   place). Keys that occur once cannot hold a repeated window and go.
3. Segments of equal key and content repeat whole. Of the others, those
   that share a key with a different segment are cut out of their texts, one
   copy of each, and go to shards by key.
4. Each shard builds its index and reports the windows that lie in two segments.
   A key with over `LARGE` different segments is a shard of its own. One with
   more than `dense` would be too large for that: its segments are cut to single
   windows instead, which meet by a 128-bit digest.
5. The windows' places come together by text, and a last pass over the written
   texts removes what they cover.

Equal content is told by BLAKE2b digests of its bytes, keyed anew for each run: 64
bits within a 64-bit key, 128 bits for single windows; words, too, count as equal
by their bytes. Every group is pre-aggregated before it moves, and no step's tasks
hold more than a text, or a shard of about `shard_bytes`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import segments as sg
from loomframe.llm.common import new_path, remove

#: (payloads, whether each is the only copy) -> (payload, window) pairs that repeat; of `only` ones.
Shard = Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]
LEAST_COPIES, LARGE = 2, 256


@dataclass(frozen=True)
class Alphabet:
    """How bytes become symbols: words, or bytes themselves."""

    by_word: bool
    window: int
    k: int
    secret: bytes = field(default_factory=lambda: os.urandom(16))

    def split(self, data: bytes) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """(symbols, body, their starts and ends in it) of a whole text; the body is the words joined by one space, or the bytes."""
        if not self.by_word:
            at = np.arange(len(data) + 1)
            return sg.BYTE[np.frombuffer(data, np.uint8)], data, at[:-1], at[1:]
        found, known = data.split(), sg.word_digests(self.secret)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        try:
            symbols = np.fromiter(map(known.get, found), np.uint64, len(found))
        except TypeError:  # some are not known
            symbols = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        starts = np.concatenate([[0], ends + 1])[: len(ends)]
        return symbols, b" ".join(found), starts, ends

    def pieces(self, symbols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(joined symbols, text of each, place of each in its text) of up to PIECE symbols; long texts overlap by a window less one."""
        step = sg.PIECE - self.window
        parts = [(i, a, s[a : a + step + self.window - 1]) for i, s in enumerate(symbols) for a in range(0, max(1, len(s) - self.window + 1), step) if len(s) >= self.window]
        lo = 0
        while lo < len(parts):
            hi, n = lo, 0
            while hi < len(parts) and (hi == lo or n + len(parts[hi][2]) <= sg.PIECE):
                n += len(parts[hi][2])
                hi += 1
            some = parts[lo:hi]
            sizes = [len(p) for _, _, p in some]
            which = np.repeat(np.arange(len(some)), sizes)
            base = np.cumsum(sizes) - sizes
            yield np.concatenate([p for _, _, p in some]), which, np.array([[i, a - b] for (i, a, _), b in zip(some, base, strict=True)])
            lo = hi


def digest(text: Column) -> Column:
    """Sixteen bytes of the SHA-256 of the UTF-8 text; null as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


class Corpus:
    """The distinct texts in a bucketed table under a folder of the shared directory."""

    def __init__(self, spark: SparkSession, texts: DataFrame):
        self.spark, self.folder, self.name = spark, new_path(spark, "repeats"), "repeats_" + uuid.uuid4().hex
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = texts.select(digest(F.col("text")).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
        one = rows.groupBy("digest").agg(F.first("text").alias("text"), F.least(F.count("*"), F.lit(LEAST_COPIES)).alias("copies"))
        one = one.withColumn("tid", F.monotonically_increasing_id())
        one.write.bucketBy(self.buckets, "digest").option("path", f"{self.folder}/texts").option("compression", "zstd").saveAsTable(self.name)

    @property
    def texts(self) -> DataFrame:
        return self.spark.table(self.name)

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.folder}/{what}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.folder)


#: A segment's first window, number of windows and whether its text has copies, in one long.
def place(first: np.ndarray, count: np.ndarray, copied: np.ndarray) -> np.ndarray:
    return (first << 20) | (count << 1) | copied


FIRST, COUNT, WEIGHT = "shiftright(at, 20)", f"shiftright(at, 1) & {(1 << 19) - 1}", "(at & 1) + 1"


def segment_rows(texts: DataFrame, alphabet: Alphabet) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, copies = batch.column(0).to_numpy(), (batch.column(1).to_numpy() >= LEAST_COPIES).astype(np.int64)
            for lo in range(0, len(tids), 200):
                symbols, bodies, starts, ends = zip(*(alphabet.split(d) for d in batch.column(2)[lo : lo + 200].to_pylist()), strict=True)
                for joined, which, where in alphabet.pieces(list(symbols)):
                    first, count, key = sg.segments(joined, which, alphabet.window, alphabet.k)
                    text, shift = where[which[first]].T if len(first) else (first, first)
                    first, content = first + shift, np.empty(len(first), np.int64)
                    edge = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else []
                    for a, b in zip(edge[:-1], edge[1:], strict=True):  # a text's segments stand together
                        t = text[a]
                        content[a:b] = sg.digests(memoryview(bodies[t]), starts[t][first[a:b]], ends[t][first[a:b] + count[a:b] + alphabet.window - 2], alphabet.secret)[:, 0]
                    columns = [key, content, tids[lo + text], place(first, count, copies[lo + text])]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["key", "content", "tid", "at"])

    return texts.select("tid", "copies", F.encode("text", "UTF-8")).mapInArrow(cut, "key long, content long, tid long, at long")


def cut_out(asked: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Rows of asked-for segments with their bytes (words joined by one space), or, for dense keys, rows of single windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                _, body, starts, ends = alphabet.split(text.as_py())
                rows = []
                for w in wanted:
                    first, count = w["at"] >> 20, (w["at"] >> 1) & ((1 << 19) - 1)
                    last = first + count + alphabet.window - 2
                    if not w["dense"]:
                        rows.append((w["key"], w["n"], w["tid"], first, 0, 0, w["own"], body[starts[first] : ends[last]]))
                    else:
                        at = np.arange(first, first + count)
                        told = sg.digests(memoryview(body), starts[at], ends[at + alphabet.window - 1], alphabet.secret, 16).tolist()
                        rows += [(w["key"], w["n"], w["tid"], i, *h, w["own"], None) for i, h in zip(at.tolist(), told, strict=True)]
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "n", "tid", "first", "h1", "h2", "own", "payload"])

    return asked.mapInArrow(cut, "key long, n long, tid long, first long, h1 long, h2 long, own long, payload binary")


def spans(corpus: Corpus, alphabet: Alphabet, shard: Shard, shard_bytes: int = 1 << 20, dense: int = 4096) -> DataFrame:
    """(tid, first, count): runs of repeated windows.

    What a join takes from an aggregate is written first: a join that reads
    shuffled rows on both sides can be split where one key has many. Rows that
    such a join gives are dealt out by text before they are written, or the next
    one would find a hot key's rows in one file.
    """
    rows = corpus.keep(segment_rows(corpus.texts, alphabet), "segments")
    often = corpus.keep(rows.groupBy("key").agg(F.sum(F.expr(WEIGHT)).alias("n")).filter(F.col("n") >= LEAST_COPIES).select("key"), "often")
    met = corpus.keep(rows.join(often, "key").repartition("tid"), "met")
    kinds = corpus.keep(met.groupBy("key", "content").agg(F.sum(F.expr(WEIGHT)).alias("n"), F.min(F.struct("tid", "at")).alias("one")), "kinds")
    shared = corpus.keep(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "shared")
    whole = met.join(kinds.filter(F.col("n") >= LEAST_COPIES).select("key", "content"), ["key", "content"]).select("tid", F.expr(FIRST).alias("first"), F.expr(COUNT).alias("count"))
    open_ = kinds.join(shared, "key").select("key", "n", F.col("one.tid").alias("tid"), F.col("one.at").alias("at"), F.when(F.col("kinds") > LARGE, F.col("key")).alias("own"), (F.col("kinds") > dense).alias("dense"))
    names = corpus.texts.select("tid", F.col("digest"))
    asked = open_.join(names, "tid").groupBy("digest").agg(F.collect_list(F.struct("key", "n", "tid", "at", "own", "dense")).alias("wanted"))
    pieces = corpus.keep(cut_out(corpus.texts.join(asked, "digest").select(F.encode("text", "UTF-8").alias("data"), "wanted"), alphabet), "pieces")
    single = pieces.filter(F.col("payload").isNull())
    twice = corpus.keep(single.groupBy("key", "h1", "h2").agg(F.sum("n").alias("total")).filter(F.col("total") >= LEAST_COPIES).select("key", "h1", "h2"), "twice")
    hot = single.join(twice, ["key", "h1", "h2"]).select("tid", "first", F.lit(1).cast("long").alias("count"))
    sharded = pieces.filter(F.col("payload").isNotNull())
    size = sharded.select(F.sum(F.length("payload"))).first()[0] or 0

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        which, at = shard(pdf["payload"].tolist(), pdf["n"].to_numpy() < LEAST_COPIES)
        order = np.lexsort((at, which))
        which, at = which[order], at[order]
        new = np.flatnonzero(np.r_[np.ones(min(1, len(at)), bool), (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)])
        return pd.DataFrame({"tid": pdf["tid"].to_numpy()[which[new]], "first": pdf["first"].to_numpy()[which[new]] + at[new], "count": np.diff(np.append(new, len(at)))})

    place_of = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("key"), F.lit(-(-size // shard_bytes) or 1)))
    cold = sharded.withColumn("shard", place_of).groupBy("own", "shard").applyInPandas(resolve, "tid long, first long, count long")
    return whole.unionByName(hot).unionByName(cold)


def covered(n: int, window: int, runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of symbols that repeated windows cover."""
    edge = np.zeros(n + 1, np.int64)
    for first, count in runs:
        edge[first] += 1
        edge[min(n, first + count + window - 1)] -= 1
    inside = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    change = np.diff(inside.astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def removed(corpus: Corpus, found: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(digest, n, n_removed, spans, kept) of every distinct text; kept is the words joined by one space, or the bytes."""
    named = found.join(corpus.texts.select("tid", "digest"), "tid").groupBy("digest").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    rows = corpus.texts.select("digest", F.encode("text", "UTF-8").alias("data")).join(named, "digest", "left").select("digest", "data", F.col("runs.first").alias("a"), F.col("runs.count").alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                for data, a, b in zip(part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                    units = data.split() if alphabet.by_word else data
                    runs = list(zip(a.as_py(), b.as_py(), strict=True)) if a.is_valid else []
                    starts, ends = (x.tolist() for x in covered(len(units), alphabet.window, runs)) if runs else ([], [])
                    keep, at = [], 0
                    for s, e in zip(starts, ends, strict=True):
                        keep.append(units[at:s])
                        at = e
                    keep.append(units[at:])
                    kept = b" ".join(w for k in keep for w in k) if alphabet.by_word else b"".join(keep)
                    out.append((len(units), sum(ends) - sum(starts), [{"start": s, "end": e} for s, e in zip(starts, ends, strict=True)], kept))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], ["digest", "n", "n_removed", "spans", "kept"])

    return rows.mapInArrow(cut, "digest binary, n long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
