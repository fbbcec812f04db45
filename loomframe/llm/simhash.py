"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: bit k is 1 if over half of a text's word shingles (repeats
included) have it set in their XXH64 (seed 42). Two distinct fingerprints link
at `radius` or fewer differing bits; documents with equal fingerprints belong
together beforehand, so only distinct fingerprints are searched.

Search: the 64 bits are cut into partitions, correlated bits together, and each
partition gets its own threshold; if the thresholds (-1: not probed) add up to
radius - partitions + 1, any linked pair is within the threshold in some
partition. Dynamic programming picks the thresholds of least estimated cost:
probe signatures plus candidate pairs, from the bits' frequencies and the
partitions' measured collisions (fixed-size statistics of all fingerprints).
Fingerprints are indexed under their value in each partition, probe all values
within its threshold, and candidates are verified over all 64 bits.

A signature that more than `dense` fingerprints share is not paired up: they are
linked through the codes within half the radius of each, which two fingerprints
share exactly if they differ by the radius or less. That is exact for an even
radius and linear in their number (65 codes each for 2 bits, 2,081 for 4), and
gives the same components as all pairs.

`near_copies` finds documents at a similarity of shingles with the same parts.

Defined results: null, empty or wordless text has fingerprint 0, which links as
any other; fewer words than a shingle: the whole sequence is one; null ids form
no component of their own but may share one; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import written
from loomframe.llm.components import components

SEED, BITS = 42, 64


def hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """XXH64 of the word shingles. A-Z are lower-cased; words are runs without ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    whole = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(parts) - shingle + 1)
    starts, stops = (ends - sizes)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """As an unsigned number, bit k of which is 1 if over half of the hashes have it set; 0 without words."""
    h = hashes(text, shingle)
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[lo : lo + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`docs` with a column `fp` (the fingerprint's 64 bits as a long) in place of the text."""
    own = [c for c in docs.columns if c != text_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col), "fp long"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(len(own)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(fp)], [*own, "fp"])

    return docs.select(*own, text_col).mapInArrow(batches, schema)


def statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints (long columns of 64 bits), and how many have both bits of each pair (the diagonal: the bit)."""
    width = BITS * len(distinct.columns)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # a fixed number of rows a task
        both, n = np.zeros((width, width)), 0
        for pdf in it:
            raw = np.ascontiguousarray(pdf.to_numpy(np.int64).astype(">i8")).view(np.uint8)
            bits = np.unpackbits(raw).reshape(-1, width).astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        at = np.triu_indices(width)
        yield pd.DataFrame({"k": np.append(at[0] * width + at[1], -1), "v": np.append(both[at], n)})

    sums = distinct.mapInPandas(count, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    both, n = np.zeros(width * width), 0
    for k, v in sums:
        if k < 0:
            n = int(v)
        else:
            both[k] = v
    both = both.reshape(width, width)
    return n, both + np.triu(both, 1).T


def partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0: the highest) in `parts` groups of nearly equal size; each takes in turn the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(like, 0)
    left, out = np.ones(len(both), bool), []
    for k in range(parts):
        size = int(left.sum()) // (parts - k)
        score, mine = like[:, left].sum(axis=1), []
        for _ in range(size):
            mine.append(int(np.argmax(np.where(left, score, -1.0))))
            left[mine[-1]] = False
            score = like[:, mine].sum(axis=1)
        out.append(sorted(mine))
    return out


def within(differ: np.ndarray, most: int) -> np.ndarray:
    """Chances that 0..most or fewer of independent bits differ."""
    d = np.zeros(most + 1)
    d[0] = 1
    for q in differ:
        d[1:] = d[1:] * (1 - q) + d[:-1] * q
        d[0] *= 1 - q
    return np.cumsum(d)


def masks(bits: Iterable[int], columns: int = 1) -> list[int]:
    """Signed 64-bit numbers, one a column, with the bits (0: the highest of the first) set."""
    out = [0] * columns
    for b in bits:
        out[b // BITS] |= 1 << (BITS - 1 - b % BITS)
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def value(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(masks(bits)[0]))


def collisions(distinct: DataFrame, options: list[list[list[Column]]], most: int) -> list[list[float]]:
    """Pairs to compare of equal values of each partition, given as columns, for each of some ways to cut the bits.

    Where many share a value, so many pairs a fingerprint: it is then linked in another way.
    """
    keys = [F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), F.xxhash64(*k).alias("v")) for o, option in enumerate(options) for i, k in enumerate(option)]
    met = distinct.select(F.inline(F.array(*keys))).groupBy("o", "i", "v").agg(F.count("*").alias("c"))
    pairs = met.filter("c > 1").groupBy("o", "i").agg(F.sum(F.col("c").cast("double") * F.least(F.col("c") - 1, F.lit(most)) / 2).alias("pairs"))
    found = {(r.o, r.i): r.pairs for r in pairs.collect()}
    return [[found.get((o, i), 0.0) for i in range(len(option))] for o, option in enumerate(options)]


def thresholds(equal: list[float], n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """Least estimated cost and thresholds (each -1..radius) adding up to radius - partitions + 1.

    The cost of a threshold is its probes and its candidate pairs: those that
    independent bits of their frequencies would give, scaled up where more pairs collide.
    """
    p, cost = np.diag(both) / max(n, 1), []
    for g, same in zip(groups, equal, strict=True):
        chance = within(2 * p[g] * (1 - p[g]), radius) * n * (n - 1) / 2
        grown = [same * max(1.0, c / max(chance[0], 1e-9)) if same > chance[0] else c for c in chance]
        cost.append({-1: 0.0, **{t: max(n, 1) * sum(comb(len(g), k) for k in range(t + 1)) + grown[t] for t in range(radius + 1)}})
    best = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (x, ts) in best.items():
            for t, y in c.items():
                if so_far + t not in step or x + y < step[so_far + t][0]:
                    step[so_far + t] = (x + y, [*ts, t])
        best = step
    return best[radius - len(groups) + 1]


def flips(bits: list[int], most: int) -> list[int]:
    """Signed 64-bit masks of up to `most` of the bits; the first is 0."""
    return [masks(some)[0] for k in range(most + 1) for some in combinations(bits, k)]


#: Masks of up to so many of the 64 bits, as one expression each.
CODES = [
    "array(0L)",
    "concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))",
    "concat(array(0L), flatten(transform(sequence(0, 63), i -> transform(sequence(-1, i - 1), j -> shiftleft(1L, i) ^ if(j < 0, 0L, shiftleft(1L, j))))))",
]


def linked(nodes: DataFrame, radius: int = 2, dense: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (node, fp) whose components are those of all links.

    Every pair that some probed signature shared by at most `dense` of them
    brings together is verified and emitted; the others link through codes
    (smallest node of each code).
    """
    if radius not in (0, 1, 2, 4):
        raise ValueError("dense signatures are exact for a radius of 0, 1, 2 or 4")
    distinct = nodes.select("node", "fp")
    n, both = statistics(distinct.select("fp"))
    options = [partitions(n, both, parts) for parts in (2, 3, 4)]
    equal = collisions(distinct, [[[value(F.col("fp"), g)] for g in groups] for groups in options], 2 * dense)
    _, chosen, groups = min(((*thresholds(e, n, both, g, radius), g) for g, e in zip(options, equal, strict=True)), key=lambda x: x[0])
    used = [(i, g, t) for i, (g, t) in enumerate(zip(groups, chosen, strict=True)) if t >= 0]
    values = F.array(*[F.struct(F.lit(i).alias("i"), value(F.col("fp"), g).alias("v")) for i, g, _ in used])
    index = distinct.select("node", "fp", F.inline(values))

    def tried(g: list[int], t: int, i: int) -> Column:
        flipped = F.array(*[F.lit(m).cast("long") for m in flips(g, t)])
        return F.transform(flipped, lambda m: F.struct(F.lit(i).alias("i"), value(F.col("fp"), g).bitwiseXOR(m).alias("v"), (m == 0).alias("own")))

    probe = distinct.select("node", "fp", F.inline(F.flatten(F.array(*[tried(g, t, i) for i, g, t in used]))))
    sizes = index.groupBy("i", "v").agg(F.count("*").alias("c"))
    probed = written(probe.join(sizes, ["i", "v"]).filter(~F.col("own") | (F.col("c") > 1)).drop("own"), "probes")
    thin = probed.filter(F.col("c") <= dense).drop("c")
    met = thin.join(index.withColumnsRenamed({"node": "b", "fp": "fp_b"}), ["i", "v"])
    pairs = met.filter((F.col("node") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= radius)).select(F.col("node").alias("a"), "b")
    # All nodes that probe or lie under a dense signature; a pair it would bring together has both here.
    thick = probed.filter(F.col("c") > dense)
    inside = index.join(thick.select("i", "v").distinct(), ["i", "v"], "left_semi").select("node", "fp").unionByName(thick.select("node", "fp")).distinct()
    if radius == 1:  # one side flipped, the other as it is
        codes = inside.select("node", F.explode(F.transform(F.expr(CODES[1]), lambda m: F.col("fp").bitwiseXOR(m))).alias("code"))
        stars = codes.join(inside.select(F.col("node").alias("b"), F.col("fp").alias("code")), "code")
    else:
        codes = inside.select("node", F.explode(F.transform(F.expr(CODES[radius // 2]), lambda m: F.col("fp").bitwiseXOR(m))).alias("code"))
        lows = codes.groupBy("code").agg(F.min("node").alias("b"), F.count("*").alias("c")).filter(F.col("c") > 1).select("code", "b")
        stars = codes.hint("merge").join(lows.hint("merge"), "code")  # rows a node has many of, which Spark's estimates leave out
    stars = stars.filter(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id of the documents reachable by links."""
    rows = written(fingerprints(docs.select(F.col(id_col), F.col(text_col)), text_col, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("low")).withColumn("node", F.col("fp")), "distinct")
    groups = components(linked(distinct.select("node", "fp"), radius))
    named = written(distinct.join(groups, "node", "left").select("fp", "low", F.coalesce("component", "node").alias("component")), "named")
    lows = written(named.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    told = written(named.join(lows, "component").select("fp", "component_id"), "components")
    return rows.join(told, "fp").select(F.col(id_col), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
