"""Substring and suffix-array dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.llm import fm_index, queries, repeats, segments, substring_dedup, suffix_array, suffix_dedup
from loomframe.llm.repeats import Alphabet

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(texts, window, by_word):
    units = [WORD.findall((t or "").encode()) if by_word else (t or "").encode() for t in texts]
    key = tuple if by_word else bytes
    seen = Counter(key(u[i : i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        mask = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if seen[key(u[i : i + window])] > 1:
                mask[i : i + window] = True
        kept = b" ".join(w for w, m in zip(u, mask) if not m) if by_word else bytes(np.frombuffer(u, np.uint8)[~mask])
        runs = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        out.append((len(u), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, words=40, shared=12):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "ccc", "dd", "e", "日本", "x1"] + [f"w{i}" for i in range(30)]
    passage = [" ".join(rng.choices(vocabulary, k=shared + 8)) for _ in range(4)]
    texts = []
    for _ in range(n):
        t = [" ".join(rng.choices(vocabulary, k=rng.randint(0, words))) for _ in range(2)]
        texts.append(f" {t[0]}\t{rng.choice(passage)}\n\n{t[1]} " if rng.random() < 0.6 else t[0])
    return [None, "", " \n", "a " * 90, "a " * 90, passage[0], "\x00 \x1f\x85", "lone", *texts, texts[0], texts[1]]


def rows(spark, operator, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("key", F.lit(1))
    ids, found, made = operator(docs, **how)
    got = ids.join(found.select("digest", "n", "n_removed", F.size("spans").alias("runs"), F.sha2("kept", 256).alias("sha")), "digest").drop("digest").collect()
    made.drop()
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    texts = corpus(seed)
    assert rows(spark, substring_dedup.repeated_words, texts, window=10) == brute(texts, 10, True)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed):
    texts = corpus(seed)
    assert rows(spark, suffix_dedup.repeated_bytes, texts, length=40) == brute(texts, 40, False)


@pytest.mark.parametrize("by_word", [True, False])
def test_dense_keys_and_pieces(spark, by_word, monkeypatch):
    """Keys with shards of their own or cut to single windows, and texts longer than a piece, change nothing."""
    texts = corpus(5, n=80)
    alphabet = Alphabet(by_word, 12 if by_word else 40, 4 if by_word else 16)
    shard = (substring_dedup.shard if by_word else suffix_dedup.shard)(alphabet.window)
    made = repeats.Corpus(spark, spark.createDataFrame([(t,) for t in texts], "text string"))
    whole = lambda **how: sorted(tuple(r) for r in repeats.removed(made, repeats.spans(made, alphabet, shard, **how), alphabet).select("digest", "n_removed").collect())
    first = whole()
    folders = ("segments", "often", "met", "kinds", "shared", "pieces", "twice")
    for what in folders:
        repeats.remove(spark, f"{made.folder}/{what}")
    monkeypatch.setattr(repeats, "LARGE", 1)
    assert whole() == first
    for what in folders:
        repeats.remove(spark, f"{made.folder}/{what}")
    assert whole(dense=1) == first
    made.drop()
    long = " ".join(texts[7:30])
    pieces = list(alphabet.pieces([alphabet.split(long.encode())[0]]))
    monkeypatch.setattr(segments, "PIECE", 200)
    small = list(alphabet.pieces([alphabet.split(long.encode())[0]]))
    keys = lambda ps: sorted({int(k) for j, w, _ in ps for k in segments.segments(j, w, alphabet.window, alphabet.k)[2]})
    assert len(small) > len(pieces) and keys(small) == keys(pieces)


def doubled(n):
    """Words of length 2^n that any polynomial hash modulo 2^64 takes as equal."""
    a, b = b"a", b"b"
    for _ in range(n):
        a, b = a + b, b + a
    return a.decode(), b.decode()


def test_words_that_collide_in_a_polynomial_hash(spark):
    words = [f"w{i}" for i in range(34)]
    texts = [" ".join([*words, x]) for x in doubled(11)]
    assert rows(spark, substring_dedup.repeated_words, texts) == brute(texts, 35, True)
    assert rows(spark, suffix_dedup.repeated_bytes, texts) == brute(texts, 200, False)


def test_long_texts_and_words_end_to_end(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randint(0, 9999)}" for _ in range(80))
    long = [f"{' '.join(f'v{rng.randint(0, 99999)}' for _ in range(9000))} {passage} {'x' * 700_000} {passage}" for _ in range(2)]
    assert rows(spark, substring_dedup.repeated_words, [*long, passage]) == brute([*long, passage], 35, True)
    texts = [t[:60_000] + passage for t in long]
    assert rows(spark, suffix_dedup.repeated_bytes, [*texts, passage]) == brute([*texts, passage], 200, False)


@pytest.mark.parametrize("name,window,by_word", [("op1_substring_dedup", 35, True), ("op2_suffix_dedup", 200, False)])
def test_registered_queries_match_brute_force(spark, name, window, by_word):
    """Over the whole table, with the production parameters."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, SF).collect())
    want = [(d.doc_id, n, gone, sha) if by_word else (d.doc_id, n, gone, runs, sha) for d, (n, gone, runs, sha) in zip(docs, brute([d.text for d in docs], window, by_word), strict=True)]
    assert got == want
    if name in queries.SQL:
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
        assert sorted(con.execute(queries.SQL[name]).fetchall()) == want


def test_empty_table(spark):
    assert rows(spark, substring_dedup.repeated_words, []) == []
    assert rows(spark, suffix_dedup.repeated_bytes, [None]) == [(0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_suffix_array_and_fm_index():
    rng = np.random.default_rng(0)
    for n in (1, 2, 40, 41, 42, 100, 997):
        for a in (1, 2, 90):
            t = rng.integers(0, a, n)
            assert suffix_array.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())
    rows = rng.integers(0, 3, (3, 200))
    wide = suffix_array.packed(31, *rows)
    assert np.array_equal(np.argsort(wide, kind="stable"), np.lexsort(rows[::-1])) and (np.diff(np.sort(wide)) == 0).sum() == 200 - len(set(map(tuple, rows.T.tolist())))
    sequences = [rng.integers(1, 5, 60) for _ in range(30)]
    index = fm_index.FMIndex(sequences, 5)
    joined, first = np.concatenate(sequences), np.arange(30) * 60
    for shortest in (1, 6, 60):
        seen = Counter(tuple(s[i : i + shortest]) for s in sequences for i in range(61 - shortest))
        want = {(k, i) for k, s in enumerate(sequences) for i in range(61 - shortest) if seen[tuple(s[i : i + shortest])] > 1}
        which, start, end = index.intervals(joined, first, np.full(30, 60), shortest)
        assert {(k, i) for k, a, b in zip(which.tolist(), start.tolist(), end.tolist()) for i in range(a, b - shortest + 1)} == want
        for k, a, b in zip(which.tolist(), start.tolist(), end.tolist()):  # none can be longer
            longer = lambda x, y: sum(s[i : i + y - x].tolist() == sequences[k][x:y].tolist() for s in sequences for i in range(61 - y + x))
            assert longer(a, b) > 1 and (a == 0 or longer(a - 1, b) < 2)
