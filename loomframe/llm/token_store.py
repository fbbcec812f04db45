"""Token ids in a content-addressed store.

Texts are encoded with the tokenizers library and an end id. A rolling hash over
the last eight ids cuts each document's ids into chunks; a chunk is stored once
under its SHA-256, in the narrowest unsigned little-endian width that holds the
vocabulary. A document's recipe lists its chunks in order; the recipes' Merkle
roots are hashed up, `FAN` at a time, to one root in the manifest. Folders:

    chunks/    digest, n, payload
    recipes/   doc_id, ordinal, start, n_tokens, digests, root
    manifest/  level, node, root

Reading checks each chunk's digest, each document's length and root, and the manifest.

Defined results: a null text is an empty one and gets the end id alone; ids and
starts go by ascending doc_id (after a column that gives the order, if any), null
first, repeated ids by content; rows repeat as often as they come; texts are
encoded whole; other columns are left; an empty table gives empty folders and no root.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm.common import remove, written
from loomframe.llm.ordering import running_sum

WINDOW, LEAST, MOST, MASK, FAN = 8, 32, 4096, np.uint32(0xFF), 1024
CACHED, LONGEST = 300_000, 48
#: Words of Latin letters; the punctuation that may stand after them; characters that Python's split takes as white space and the tokenizers' patterns do not.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01bf]+")
SIMPLE = re.compile("[\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u01bf]*")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
APART = re.compile("[\x1c-\x1f]")


class Encoder:
    """`by_word`: the tokenizer drops white space and never joins across it, so pieces can be encoded one by one.

    A piece of Latin letters is then one token of its pre-tokenizer, and goes to
    the tokenizer's model at once (lower-cased, its bytes spelled as the
    tokenizer spells them), and a run of ASCII marks after it is one by itself.
    The constructor compares both ways on each of those letters and marks, and
    keeps to the long one unless they agree. Texts of such letters and ASCII alone
    are lower-cased first, as the tokenizer would.
    """

    def __init__(self, path: str, end_id: int, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.by_word, self.end = by_word, np.array([end_id], self.kind).tobytes()
        self.spelled: dict[int, str] = {}
        #: Ids of white-space-free pieces, as bytes; those not met again while CACHED others are, go.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.short = by_word
        if by_word:
            letters = [chr(c) for c in range(0x41, 0x1C0) if PLAIN.fullmatch(chr(c))]
            tries = [w for c in letters for w in (f"{c}", f"a{c}o", f"{c}e.")] + [f"to{a}{b}" for a in MARKS for b in ("", *MARKS)]
            self.short = all(self.piece(w) == self.whole(w) for w in tries)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, piece: str) -> bytes:
        stem = piece.rstrip(MARKS) if self.short else ""
        if not stem or not PLAIN.fullmatch(stem):
            return self.whole(piece)
        word = stem.lower()
        if word != piece:
            return self.ids(word) + (self.ids(piece[len(stem) :]) if len(stem) < len(piece) else b"")
        if not word.isascii():
            for c in set(word):
                if ord(c) not in self.spelled:
                    self.spelled[ord(c)] = "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c))
            word = word.translate(self.spelled)
        return array("H" if self.kind == "<u2" else "I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def ids(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.piece(piece)
            if len(piece) <= LONGEST:
                if len(self.known) >= CACHED:
                    self.old, self.known = self.known, {}
                self.known[piece] = found
        return found

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id, one after the other; where each text's end).

        Words meet first: each different one of the texts is looked up or encoded once.
        """
        apart = [not self.by_word or bool(APART.search(t or "")) for t in texts]
        lowered = ["" if own or not t else t.lower() if self.short and (t.isascii() or SIMPLE.fullmatch(t)) else t for t, own in zip(texts, apart, strict=True)]
        lists = pc.utf8_split_whitespace(pa.array(lowered, pa.large_string()))
        words = pc.dictionary_encode(lists.flatten())
        known = [self.ids(w) if w else b"" for w in words.dictionary.to_pylist()]
        ends = lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()
        codes, at = words.indices.to_numpy(), np.arange(len(texts))
        whole = np.flatnonzero(apart)
        extra = [*(self.whole(texts[i] or "") for i in whole), self.end]
        which = np.concatenate([len(known) + np.arange(len(whole)), np.full(len(at), len(known) + len(whole))])
        text_of = np.concatenate([whole, at])
        order = np.argsort(text_of, kind="stable")  # a text that is encoded whole stands before its end
        codes = np.insert(codes.astype(np.int64), ends[text_of[order]], which[order])
        known += extra
        size = np.array([len(x) for x in known], np.int64) // np.dtype(self.kind).itemsize
        flat, start = np.frombuffer(b"".join(known), self.kind), np.cumsum(size) - size
        each = size[codes]
        stop = np.cumsum(each)
        ids = flat[np.repeat(start[codes] - (stop - each), each) + np.arange(stop[-1])]
        per = np.cumsum(np.diff(ends, prepend=0) + 1 + np.array(apart, np.int64))
        return ids, stop[per - 1]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int, by_word: bool) -> Encoder:
    """One for each Python worker, whatever tasks it runs."""
    return Encoder(path, end_id, by_word)


def merkle(digests: list[bytes]) -> bytes:
    level = digests or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document of a batch's joined ids, whose documents end at `ends`."""
    h = np.zeros(len(ids), np.uint32)
    for k in range(min(WINDOW, len(ids))):
        h[k:] = h[k:] + (ids[: len(ids) - k].astype(np.uint32) + np.uint32(1)) * np.uint32(pow(0x9E3779B1, k + 1, 1 << 32))
    h ^= h >> np.uint32(15)
    found = (np.flatnonzero((h * np.uint32(0x85EBCA6B) >> np.uint32(16)) & MASK == 0) + 1).tolist()
    out, i, start = [], 0, 0
    for end in ends.tolist():
        mine, at = [], start
        while i < len(found) and found[i] < end:
            if found[i] - at >= LEAST:  # the hash then looks at this document's ids alone
                while found[i] - at > MOST:
                    at += MOST
                    mine.append(at)
                if found[i] - at >= LEAST:
                    at = found[i]
                    mine.append(at)
            i += 1
        while end - at > MOST:
            at += MOST
            mine.append(at)
        out.append([*mine, end])
        start = end
    return out


def chunk_lists(ids: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(Merkle roots, lists of chunks) of documents whose ids end at `ends`; payloads are not copied."""
    width, joined = ids.itemsize, ids.tobytes()
    stops = cuts(ids, ends)
    last = np.array([x for mine in stops for x in mine], np.int64)
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)[: len(last)]
    view = memoryview(joined)
    digests = [hashlib.sha256(view[a * width : b * width]).digest() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    per = np.concatenate([[0], np.cumsum([len(mine) for mine in stops])]).astype(np.int32)
    binary = lambda data, at: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    payloads = binary(joined, np.append(0, last * width))
    chunks = pa.StructArray.from_arrays([binary(b"".join(digests), np.arange(len(last) + 1) * 32), pa.array((last - first).astype(np.int32)), payloads], ["digest", "n", "payload"])
    roots = pa.array([merkle(digests[a:b]) for a, b in zip(per[:-1].tolist(), per[1:].tolist(), strict=True)], pa.binary())
    return roots, pa.ListArray.from_arrays(pa.array(per), chunks)


def in_slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of a text column; a longer text is one by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes // 2) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def encoded(docs: DataFrame, path: str, end_id: int, by_word: bool, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """(rid, doc_id, seq, n_tokens, root, chunks) of every row; rid tells rows apart, seq is `order_col` or null."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(path, end_id, by_word)
        for batch in batches:
            for part in in_slices(batch, 3):
                ids, ends = to_ids(part.column(3).to_pylist())
                roots, chunks = chunk_lists(ids, ends)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.diff(ends, prepend=0)), roots, chunks], ["rid", "doc_id", "seq", "n_tokens", "root", "chunks"])

    seq = F.col(order_col) if order_col else F.lit(None)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), seq.cast("long").alias("seq"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "rid long, doc_id long, seq long, n_tokens long, root binary, chunks array<struct<digest:binary,n:int,payload:binary>>")


def write_store(docs: DataFrame, out: str, path: str, end_id: int, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> None:
    """The store of `docs` in folder `out`; documents stand by `order_col` (a long), if given, then by id.

    Ids are made once and written; chunks meet by digest, each task sending one
    copy of a chunk at most; starts are summed over narrow rows, which the
    recipes' chunk lists join afterwards.
    """
    spark = docs.sparkSession
    staged = f"{out}/staged"
    encoded(docs, path, end_id, by_word, id_col, text_col, order_col).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.parquet(staged)
    rows.select(F.inline("chunks")).dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{out}/chunks")
    placed = running_sum(rows.select("rid", "doc_id", "seq", "n_tokens", "root"), "n_tokens", "seq", "doc_id", "root")
    recipes = placed.drop("seq").join(rows.select("rid", F.col("chunks.digest").alias("digests")), "rid").drop("rid")
    recipes.repartitionByRange("start").sortWithinPartitions("start").write.option("compression", "zstd").parquet(f"{out}/recipes")
    remove(spark, staged)
    tree(spark.read.parquet(f"{out}/recipes")).write.parquet(f"{out}/manifest")


def tree(recipes: DataFrame) -> DataFrame:
    """(level, node, root) of the Merkle tree over the recipes' roots: FAN children a node, one node on top."""
    level = recipes.select(F.col("ordinal").alias("node"), "root")
    out, n = recipes.sparkSession.createDataFrame([], "level int, node long, root binary"), recipes.count()
    depth = 0
    while n and (n > 1 or not depth):
        depth, n = depth + 1, -(-n // FAN)
        children = F.array_sort(F.collect_list(F.struct("node", "root")))  # FAN at most
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("parent")).agg(F.unhex(F.sha2(F.array_join(F.transform(children, lambda c: F.hex(c["root"])), ""), 256)).alias("root")).withColumnRenamed("parent", "node")
        out = out.unionByName(level.select(F.lit(depth).alias("level"), "node", "root"))
    return out


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), reflected as in CRC-32, modulo its polynomial."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(bit)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ np.uint32(0xEDB88320) * (b & np.uint32(1))
    return out


def shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC values with `n_bytes` zero bytes' worth of shift: what a chunk adds to its whole, by what follows it."""
    power, left, out = np.array([1 << 23], np.uint32), n_bytes.astype(np.int64).copy(), crc.copy()
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = multiply(out[odd], np.broadcast_to(power, odd.sum()))
        power, left = multiply(power, power), left >> 1
    return out


def chunk_sums(chunks: DataFrame, width: int) -> DataFrame:
    """(digest, n, crc) from the stored payloads, each held against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if any(hashlib.sha256(p).digest() != d for d, p in zip(digests, payloads, strict=True)):
                raise ValueError("a stored chunk does not have its digest")
            ids = [np.frombuffer(p, f"<u{width}").astype("<u4") for p in payloads]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64())], ["digest", "n", "crc"])

    return chunks.select("digest", "payload").mapInArrow(read, "digest binary, n long, crc long")


def check_manifest(spark: SparkSession, out: str) -> None:
    """Raises unless the recipes' roots, hashed up again, give the manifest's nodes."""
    again = tree(spark.read.parquet(f"{out}/recipes").select("ordinal", "root"))
    stored = spark.read.schema(again.schema).parquet(f"{out}/manifest")
    if not stored.exceptAll(again).unionByName(again.exceptAll(stored)).isEmpty():
        raise ValueError(f"the manifest of {out} does not have its recipes' roots")


def read_sums(spark: SparkSession, out: str, width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store: chunk sums joined to the recipes and put together in order.

    The CRC of a document is the sum of its chunks' shifted by the bytes after
    them, so payloads are read once, where they lie, and only sums move. Chunks
    are held against their digests, documents against their recipes' length and
    Merkle root, and the roots against the manifest; what fails raises.
    """
    check_manifest(spark, out)
    recipes = spark.read.parquet(f"{out}/recipes")
    pieces = recipes.select("start", F.posexplode("digests").alias("seq", "digest"))
    met = pieces.join(chunk_sums(spark.read.parquet(f"{out}/chunks"), width), "digest", "left").select("start", F.struct("seq", "digest", "n", "crc").alias("c"))
    per = met.groupBy("start").agg(F.array_sort(F.collect_list("c")).alias("c"))
    lost = F.raise_error(F.lit("a chunk of the store is lost"))
    flat = per.select("start", "c.digest", F.transform("c.n", lambda n: F.coalesce(n, lost)).alias("n"), "c.crc")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            n, crc = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.uint32)
            first = np.cumsum(sizes) - sizes
            total = np.add.reduceat(n, first)
            after = np.repeat(total, sizes) - (np.cumsum(n) - np.repeat(np.cumsum(n)[first] - n[first], sizes))
            whole = np.bitwise_xor.reduceat(shifted(crc, after * 4), first)
            roots = pa.array(map(merkle, batch.column(1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(whole.astype(np.int64)), roots], ["start", "n", "ids_crc32", "again"])

    told = flat.mapInArrow(combine, "start long, n long, ids_crc32 long, again binary")
    sound = (F.col("n") == F.col("n_tokens")) & (F.col("again") == F.col("root"))
    bad = F.raise_error(F.lit("a document of the store does not have its recipe's length and root"))
    read = recipes.select("doc_id", "start", "n_tokens", "root").join(told, "start", "left")
    return read.select("doc_id", "start", F.when(sound, F.col("n_tokens")).otherwise(bad).alias("n_tokens"), "ids_crc32")


def documents(spark: SparkSession, out: str, width: int) -> DataFrame:
    """(doc_id, start, ids) rebuilt from recipes and chunks."""
    recipes, chunks = spark.read.parquet(f"{out}/recipes"), spark.read.parquet(f"{out}/chunks")
    pieces = recipes.select("doc_id", "start", F.posexplode("digests").alias("seq", "digest")).join(chunks.select("digest", "payload"), "digest")
    per = pieces.groupBy("doc_id", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda c: c["payload"]).alias("p"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([np.frombuffer(b"".join(p), f"<u{width}").astype(np.int64) for p in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], ids], ["doc_id", "start", "ids"])

    return per.mapInArrow(rebuild, "doc_id long, start long, ids array<long>")
