"""The pipeline against a plain version of its stages."""

import hashlib
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from loomframe.llm import decontaminate, language_id, mixing, queries
from tests.llm.test_near_copies import grouped, shingles

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_a_plain_version(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r for r in frame.collect()}
    model = language_id.fit(language_id.learning_rows(frame))
    kept = [d for d in sorted(docs) if (lambda lang, score: lang != "und" and score >= P.LEAST_SCORE)(*model.predict(docs[d].text))]
    group = grouped({d: shingles(docs[d].text) for d in kept})
    kept = [d for d in kept if group[d] == d]
    items = [decontaminate.shingles(decontaminate.words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    has = {d: decontaminate.shingles(decontaminate.words(docs[d].text)) for d in kept}
    kept = [d for d in kept if all(len(i & has[d]) < 0.8 * len(i) for i in items)]
    share = mixing.shares(sorted({docs[d].source for d in kept}), queries.WEIGHTS)
    slots = {(s, turn): slot for s, turn, slot, _, _ in mixing.schedule(share)}
    at = {}
    for s in share:
        mine = sorted((d for d in kept if docs[d].source == s), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), d))
        for rank, d in enumerate(mine):
            cycle, turn = divmod(rank // mixing.BLOCK, share[s])
            at[d] = ((cycle * mixing.CYCLE + slots[s, turn]) * mixing.BLOCK) + rank % mixing.BLOCK
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d in sorted(kept, key=at.get):
        ids = tokenizer.encode(docs[d].text, add_special_tokens=False).ids + [queries.END_ID]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in P.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == want
    assert 0.5 * len(docs) < len(kept) < len(docs)


def test_stages_keep_columns_and_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
    assert P.STAGES[-1][1](spark, empty, SF).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "the and of it is a the", None, "s", 3), (None, "the and of it is a the", None, "s", 3)], empty.schema)
    for _, stage in P.STAGES:
        stage(spark, odd, SF).count()
