"""Near copies of documents: SimHash candidates by the generalised pigeonhole, verified on exact shingle similarity.

Two texts are near copies if the sets of their `SHINGLE`-word shingles (A-Z
lower-cased, words are runs without ASCII white space, a shorter text is one
shingle) have a Jaccard similarity of `SIMILARITY` or more.

1. Texts of equal shingle sets are one node; its document with the smallest id
   stands for it.
2. Each node has a SimHash of 64 x `TABLES` bits of its distinct words, which edits
   change least. `simhash.partitions` groups correlated bits,
   `simhash.thresholds` allocates unequal thresholds by dynamic programming, and
   the number of partitions with the least estimated cost is taken. So every
   pair within `RADIUS` bits, and most beyond, meet under some signature: see
   README for the measured recall.
3. A signature's nodes need not all be paired: only components count. In each
   round some of the nodes outside the signature's main component (all of them,
   if few) are pivots and are compared with all its nodes; a pair is verified if
   it is not yet connected, differs in at most `GUARD` bits of a SimHash of its
   shingles, and its sets' sizes allow the similarity. The signature is settled
   once all its nodes outside the main component have been pivots, or all are
   connected. So no link is lost, and a group whose members link takes a few pivots.
   What stays outside (texts of the signature that are no near copies) is compared
   with all of it.
4. Verification compares whole shingle sets, of those texts alone: of the first
   round's distinct pairs, which are few for a signature, and inside the join of
   the later rounds, so that hot signatures give no rows but links.

Defined results: texts without words (null, empty, white space) are one node;
null ids come last, equal ids by row; repeated rows count as copies; an empty
table gives an empty one; other columns, of any name, are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import simhash
from loomframe.llm.common import Scratch, written
from loomframe.llm.components import components
from loomframe.llm.segments import mix

SHINGLE, SIMILARITY, TABLES, RADIUS, GUARD = 5, 0.8, 4, 12, 20
#: Pivots of a signature in the first round, and how many times more in each round after it.
PIVOTS, GROWTH = 4, 8
#: Narrow rows (one long) that may be broadcast: 4 MB.
SMALL = 1 << 19
FPS = [f"f{k}" for k in range(TABLES)]
STEP = np.uint64(0x9E3779B97F4A7C15)
STEPS = STEP * np.arange(1, TABLES + 1, dtype=np.uint64)


class WordHashes(dict):
    """XXH64 of words, by word; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, simhash.SEED)
        return h


HASHES = WordHashes()


def majority(h: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Fingerprints (one number for each step) whose bits are 1 if set in over half of the hashes, mixed anew by each step."""
    counts = np.zeros(64 * len(steps), np.int64)
    for lo in range(0, len(h), 255):  # so many fit in a byte
        x = mix(h[lo : lo + 255, None] + steps).astype(">u8")
        bits = np.unpackbits(x.view(np.uint8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h)).view(">u8").astype(np.uint64)


def shingles(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Distinct shingle hashes, sorted, of the texts whose word hashes end at `ends`."""
    h = np.zeros(len(hashes), np.uint64)
    for k in range(min(SHINGLE, len(h))):
        h[: len(h) - k] = mix(h[: len(h) - k] * STEP + hashes[k:])
    out, lo = [], 0
    for hi in ends.tolist():
        if hi - lo >= SHINGLE:
            out.append(np.unique(h[lo : hi - SHINGLE + 1]))
        else:  # the whole sequence
            x = np.zeros(1, np.uint64)
            for w in hashes[lo:hi]:
                x = mix(x * STEP + w)
            out.append(x[: hi > lo])
        lo = hi
    return out


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashed(texts: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the distinct words, distinct shingle hashes) of each text, some texts at a time."""
    for lo in range(0, len(texts), 256):
        parts = [words(t) for t in texts[lo : lo + 256]]
        each = [np.fromiter(map(HASHES.__getitem__, p), np.uint64, len(p)) for p in parts]
        sets = shingles(np.concatenate(each), np.cumsum([len(p) for p in parts]))
        yield from ((np.unique(w), s) for w, s in zip(each, sets, strict=True))


def prints(texts: pd.Series) -> pd.DataFrame:
    """Fingerprints, guard, 128-bit digest and size of the shingle set."""
    out = np.zeros((len(texts), TABLES + 4), np.uint64)
    for row, (w, s) in zip(out, hashed(texts), strict=True):
        if len(s):
            row[:TABLES] = majority(w, STEPS)
            row[TABLES:] = majority(s, STEPS[:1])[0], mix(s + STEPS[0]).sum(), mix(s + STEPS[1]).sum(), len(s)
    return pd.DataFrame(out.view(np.int64), columns=[*FPS, "guard", "k0", "k1", "n"])


def shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([s.view(np.int64) for _, s in hashed(texts)], dtype=object)


def flipped(bits: list[int], most: int) -> list[list[int]]:
    """Masks, one signed number for each fingerprint column, of up to `most` of the bits; the first flips none."""
    sets = [s for k in range(most + 1) for s in combinations(bits, k)]
    return [simhash.masks(s, TABLES) for s in sets]


def signatures(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, node, guard, n) of every signature that some node has and another one has or probes."""
    n, both = simhash.statistics(nodes.select(*FPS))
    options = [simhash.partitions(n, both, parts) for parts in (RADIUS + 1, 2 * RADIUS // 3, RADIUS // 2)]
    keys = [[[F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(FPS, simhash.masks(g, TABLES), strict=True)] for g in groups] for groups in options]
    plans = []
    for groups, equal, key in zip(options, simhash.collisions(nodes, keys, 2 * PIVOTS), keys, strict=True):
        plans.append((*simhash.thresholds(equal, n, both, groups, RADIUS), groups, key))
    _, chosen, groups, key = min(plans, key=lambda p: p[0])

    def probed(i: int, bits: list[int], t: int, own: list[Column]) -> Column:
        flips = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f) for f, x in zip(FPS, m, strict=True)]) for m in flipped(bits, t)])
        value = lambda m: F.xxhash64(F.lit(i), *[c.bitwiseXOR(m[f]) for f, c in zip(FPS, own, strict=True)])
        return F.transform(flips, lambda m, k: F.struct(value(m).alias("v"), (k == 0).alias("own")))

    found = F.flatten(F.array(*[probed(i, g, t, c) for i, (g, t, c) in enumerate(zip(groups, chosen, key, strict=True)) if t >= 0]))
    members = nodes.select("node", "guard", "n", F.inline(found))
    often = members.groupBy("v").agg(F.count("*").alias("c"), F.max("own").alias("own")).filter("c > 1 and own").select("v")
    return members.drop("own").join(scratch.written(often, "signatures"), "v")


def unsettled(members: DataFrame) -> DataFrame:
    """(v, main, rest): signatures of more than one component, the one with most nodes, and the number of nodes outside it."""
    per = members.groupBy("v", "comp").agg(F.count("*").alias("c"))
    most = per.groupBy("v").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    return most.select("v", F.col("m.comp").alias("main"), (F.col("all") - F.col("m.c")).alias("rest")).filter("rest > 0")


def sides(members: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """The signatures' nodes, and this round's pivots with columns named _p."""
    own = [c for c in members.columns if c not in ("main", "rest")]
    chosen = (F.col("comp") != F.col("main")) & (F.pmod(F.xxhash64("node", "v"), "rest") < pivots)
    return members.select(*own), members.filter(chosen).select(*own).toDF(*[f"{c}_p" for c in own])


def likely(similarity: float) -> Column:
    """Whether an unconnected node and pivot of a signature may be similar."""
    alike = F.bit_count(F.col("guard").bitwiseXOR(F.col("guard_p"))) <= GUARD
    sized = F.least("n", "n_p") >= similarity * F.greatest("n", "n_p")
    return (F.col("v") == F.col("v_p")) & (F.col("comp") != F.col("comp_p")) & alike & sized


def pairs_of(met: DataFrame) -> DataFrame:
    return met.select(F.least("node", "node_p").alias("a"), F.greatest("node", "node_p").alias("b")).distinct()


def similar(x: str, y: str, similarity: float) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common / (F.size(x) + F.size(y) - common) >= similarity


def only(rows: DataFrame, key: str, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """`rows` whose key is among the `n` distinct `ids` (or not, by `how`); they are broadcast only if few."""
    return rows.join(F.broadcast(ids) if n <= SMALL else ids, key, how)


def shingle_table(ids: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, s) of the ids (node); texts: (node, text)."""
    ids = scratch.written(ids.distinct(), "verified-nodes")
    shingle_set = F.pandas_udf(shingle_sets, "array<long>")
    return scratch.written(only(texts, "node", ids, ids.count()).select("node", shingle_set("text").alias("s")), "shingle-sets")


def links(members: DataFrame, texts: DataFrame, pivots: int, similarity: float, first: bool, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of at least the similarity that the pivots of this round find."""
    if not first:
        open_at = members.groupBy("node").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # a node has a fixed number of signatures
        members = scratch.written(members.join(scratch.written(open_at, "signatures-of"), "node"), "members-in")
    nodes, chosen = sides(members, pivots)
    if first:
        pairs = scratch.written(pairs_of(nodes.join(chosen, likely(similarity))), "candidates")
        sets = shingle_table(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts, scratch)
        met = pairs.join(sets.toDF("a", "s"), "a").join(sets.toDF("b", "s_p"), "b")
        return met.filter(similar("s", "s_p", similarity)).select("a", "b")
    # The first open signature that a pair shares compares it; if one that is settled did not connect it, it is not similar.
    once = likely(similarity) & (F.array_intersect("vs", "vs_p")[0] == F.col("v"))
    hit = scratch.written(nodes.join(chosen, once, "left_semi"), "likely-nodes")
    hitting = scratch.written(chosen.join(nodes, once, "left_semi"), "likely-pivots")
    sets = shingle_table(hit.select("node").unionByName(hitting.select(F.col("node_p").alias("node"))), texts, scratch)
    hit = scratch.written(hit.join(sets, "node"), "nodes-with-sets")
    hitting = scratch.written(hitting.join(sets.toDF("node_p", "s_p"), "node_p"), "pivots-with-sets")
    return pairs_of(hit.join(hitting, once & similar("s", "s_p", similarity)))


def groups(nodes: DataFrame, texts: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame:
    """(node, component) of the nodes with links; the component is its smallest node."""
    keep = scratch.written
    members = keep(signatures(nodes, scratch).withColumn("comp", F.col("node")), "members")
    stars, first = None, True
    while True:
        open_ = keep(members.join(keep(unsettled(members), "unsettled"), "v"), "unsettled-members")
        if stars is not None and open_.isEmpty():
            return stars
        edges = keep(links(open_, texts, pivots, similarity, first, scratch), "links")
        if first or not edges.isEmpty():
            stars = keep(components(edges if first else edges.unionByName(stars.toDF("a", "b")), keep), "stars")
        left = open_.filter(F.col("rest") > pivots).select("v", "node", "guard", "n")
        left = left.join(stars.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        members, pivots, first = keep(left, "members"), pivots * GROWTH, False


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one document of each group of near copies: that with the smallest id."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    told = F.pandas_udf(prints, ", ".join(f"{c} long" for c in [*FPS, "guard", "k0", "k1", "n"]))
    rows = docs.select(own, F.col(id_col).alias("id"), told(text_col).alias("p"), F.monotonically_increasing_id().alias("uid"))
    rows = written(rows.select("row", "id", "uid", "p.*"), "fingerprinted")
    scratch = Scratch(docs.sparkSession, "near-copies")
    keep = scratch.written
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("low")
    nodes = rows.groupBy("k0", "k1").agg(first, *[F.first(c).alias(c) for c in [*FPS, "guard", "n"]])
    nodes = keep(nodes.select("low", F.col("low.uid").alias("node"), *FPS, "guard", "n"), "nodes")
    stars = groups(nodes.select("node", *FPS, "guard", "n"), rows.select(F.col("uid").alias("node"), F.col(f"row.`{text_col}`").alias("text")), scratch, similarity)
    comp = nodes.select("low", "node").join(stars, "node", "left").select("low", F.coalesce("component", "node").alias("component"))
    kept = keep(comp.groupBy("component").agg(F.min("low").alias("low")).select(F.col("low.uid").alias("uid")), "kept")
    gone = written(rows.select("uid").join(kept, "uid", "left_anti"), "dropped")
    scratch.drop()
    return only(rows, "uid", gone, gone.count(), "left_anti").select("row.*")
