"""Near copies against brute force: exact shingle sets, all pairs."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from loomframe.llm import near_copies
from loomframe.llm.common import Scratch, written

SF = "/root/testdata/sf0.1"


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similarity(a, b):
    return len(a & b) / (len(a | b) or 1) if a != b else 1.0


def grouped(sets, least=0.8, pairs=None):
    """{id: smallest id of its group} for {id: set}; `pairs` of ids to compare, or all."""
    low = {k: k for k in sets}

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2) if pairs is None else pairs:
        if similarity(sets[a], sets[b]) >= least:
            x, y = sorted((root(a), root(b)))
            low[y] = x
    return {k: root(k) for k in sets}


def prefix_pairs(sets, least=0.8):
    """All pairs that can be similar, by their rarest shingles."""
    seen = {}
    for s in sets.values():
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    index, out = {}, set()
    for k, s in sets.items():
        for x in sorted(s, key=lambda x: (seen[x], x))[: len(s) - int(-(-least * len(s) // 1)) + 1]:
            out |= {tuple(sorted((k, other))) for other in index.get(x, ())}
            index.setdefault(x, []).append(k)
    return out


def corpus():
    """Texts, a hot group of near copies of two texts some of which are near no other, others, and exact copies."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    texts = [" ".join(b) for b in bases]
    for k in range(160):
        words = list(bases[k % 2])
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words) if k % 7 else "\t" + " ".join(words).upper() + "\n\n")
    return [*texts, None, "", " \n", "a", "A", "a b c d", "a b c d e", "a b c d e f", "x " * 3000, "\x00 \x1f\x85 é"]


@pytest.mark.parametrize("pivots", [1, 4, 1000])
def test_no_link_of_a_signature_is_lost(spark, pivots, monkeypatch):
    """With a guard that passes all and one signature for all nodes, groups are those of all pairs, whatever the pivots."""
    monkeypatch.setattr(near_copies, "GUARD", 64)
    monkeypatch.setattr(near_copies, "signatures", lambda nodes, scratch: nodes.select(F.lit(1).cast("long").alias("v"), "node", "guard", "n"))
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    told = F.pandas_udf(near_copies.prints, ", ".join(f"{c} long" for c in [*near_copies.FPS, "guard", "k0", "k1", "n"]))
    first = frame.withColumn("p", told("text")).select("node", "p.*").dropDuplicates(["k0", "k1"])
    nodes = written(first.select("node", *near_copies.FPS, "guard", "n"), "nodes")
    kept = sorted(r.node for r in nodes.select("node").collect())
    sets = {k: shingles(texts[k]) for k in kept}
    got = {r.node: r.component for r in near_copies.groups(nodes, frame, Scratch(spark, "near"), pivots=pivots).collect()}
    assert {k: got.get(k, k) for k in kept} == grouped(sets)


def test_one_of_each_edges(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(corpus())] + [(None, "a b c d", "x", 1), (None, "only with a null id here", "x", 2), (3, "shared id but other words", None, None), (0, None, "r", 1), (0, None, "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, `a.b` int").withColumn("row", F.lit("clash")).withColumn("guard", F.lit(0))
    out = near_copies.one_of_each(docs)
    got = out.collect()
    assert out.columns == docs.columns
    sets = {(r[0] is None, r[0] or 0, k): shingles(r[1]) for k, r in enumerate(rows)}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    want = grouped({k: s for s, k in first.items()})
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((none, i, rows[k][1] or "") for none, i, k in set(want.values()))
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_words_in_another_order_are_no_copy(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(200)]
    changed = [w if i % 50 else "other" + w for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(sorted(words)), " ".join(changed), " ".join(words).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == [0, 1]


def test_recall_on_the_whole_table(spark):
    """Of the documents of sf0.1 that all-pairs groups drop beyond exact copies, nine in ten at least go; no other does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    nodes = {k: s for s, k in first.items()}
    want = {k for k, low in grouped(nodes, pairs=prefix_pairs(nodes)).items() if k == low}
    got = {r.doc_id for r in near_copies.one_of_each(docs).select("doc_id").collect()}
    near = set(nodes) - want
    assert want <= got and len(near) > 40
    assert len(near - got) >= 0.9 * len(near) and got <= set(nodes)
