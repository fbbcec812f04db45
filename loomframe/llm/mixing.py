"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in the order of their ids' MD5 and cut into blocks. Weights
are whole shares of a cycle of `cycle` slots; block j (from 0) of a source with
share q is released at slot floor(j cycle / q) and due by slot
ceil((j + 1) cycle / q). Earliest deadline first among released blocks fills
each slot with one block and keeps every source within one block of its target
at every slot; as shares add up to the cycle, the schedule repeats. So one
cycle's slots (a table that grows with the sources, not with the documents) are made in
advance, and every document finds its slot by a join on (source, block number
in the cycle). When a source has no more blocks, its slots stay empty and the
others keep their proportions: no document is dropped or repeated.

Only DataFrame functions run on the documents. Defined results: a null source
is a source of its own; sources without a weight share what the listed leave (one
slot each, if nothing is left); a null key sorts as an empty one; rows repeat as often
as they come; texts and other columns are carried along; an empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.ordering import numbered

CYCLE, BLOCK, MOST_SLOTS = 1000, 16, 1 << 20


def targets(sources: list[str | None], weights: Mapping[str, float]) -> dict[str | None, float]:
    """Target shares, adding up to 1; sources without a weight share what the listed leave."""
    rest = [s for s in sources if s not in weights]
    listed = {s: float(weights[s]) for s in sources if s in weights}
    left = max(0.0, 1 - sum(listed.values()))
    want = {s: listed.get(s, left / len(rest) if rest else 0.0) for s in sources}
    total = sum(want.values())
    return {s: w / total if total else 1 / len(sources) for s, w in want.items()}


def shares(sources: list[str | None], weights: Mapping[str, float], cycle: int = CYCLE) -> dict[str | None, int]:
    """Whole slots of each source in a cycle of `cycle` slots at least; remainders go to the largest fractions.

    The cycle grows, up to MOST_SLOTS, until the least positive target has a
    slot, so every source is within one slot of its target. One that would have
    none even then (or has target 0) gets one, taken from the largest.
    """
    want = targets(sources, weights)
    least = min((w for w in want.values() if w > 0), default=1.0)
    cycle = max(cycle, len(sources), min(MOST_SLOTS, int(-(-1 // least))))
    exact = {s: round(w * cycle, 9) for s, w in want.items()}
    out = {s: int(x) for s, x in exact.items()}
    order = sorted(sources, key=lambda s: (int(exact[s]) - exact[s], s is not None, s or ""))
    for s in order[: cycle - sum(out.values())]:
        out[s] += 1
    for s in order:
        if not out[s]:
            out[max(out, key=out.get)] -= 1
            out[s] = 1
    return out


def schedule(share: Mapping[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block in the cycle, slot, release, deadline) of one cycle, earliest deadline first."""
    cycle, out, ready = sum(share.values()), [], []
    order = sorted(share, key=lambda s: (s is not None, s or ""))
    later = [(0, i, 0) for i in range(len(order))]  # (release, source, block)
    for slot in range(cycle):
        while later and later[0][0] <= slot:
            release, i, block = heapq.heappop(later)
            heapq.heappush(ready, (-(-(block + 1) * cycle // share[order[i]]), i, block, release))
        deadline, i, block, release = heapq.heappop(ready)
        out.append((order[i], block, slot, release, deadline))
        if block + 1 < share[order[i]]:
            heapq.heappush(later, ((block + 1) * cycle // share[order[i]], i, block + 1))
    return out


def mixed(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", key_col: str = "doc_id", block: int = BLOCK, cycle: int = CYCLE) -> DataFrame:
    """`docs` with mix_block, mix_release, mix_deadline, mix_slot and mix_at; rows by mix_at are the mixture.

    Slots count on over the cycles. One count for each source reaches the driver,
    and the cycle grows with the sources and their least target (see `shares`).
    """
    spark = docs.sparkSession
    counts = sorted(((r.s, r.n) for r in docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    own = docs.columns
    if not counts:
        return docs.select(*own, *[F.lit(0).cast("long").alias(c) for c in ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_at")])
    plan = schedule(shares([s for s, _ in counts], weights, cycle))
    firsts, so_far = {}, 0
    for s, n in counts:
        firsts[s], so_far = so_far, so_far + n
    own_slots = Counter(p[0] for p in plan)
    known = spark.createDataFrame([(s, firsts[s], own_slots[s]) for s, _ in counts], "s string, first long, share long")
    slots = spark.createDataFrame([(str(s is None).lower(), s or "", *rest) for s, *rest in plan], "_null string, _source string, _turn long, _slot long, _release long, _deadline long")
    rows = docs.select(F.struct(*own).alias("_row"), F.col(source_col).alias("_s"), F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit(""))).alias("_h"), F.col(key_col).alias("_k"))
    at = numbered(rows, "_s", "_h", "_k", name="_ordinal").join(F.broadcast(known), F.col("_s").eqNullSafe(F.col("s")))
    at = at.withColumn("_rank", F.col("_ordinal") - F.col("first")).withColumn("_block", F.floor(F.col("_rank") / block))
    at = at.withColumns({"_turn": F.col("_block") % F.col("share"), "_cycle": F.floor(F.col("_block") / F.col("share")), "_null": F.col("_s").isNull().cast("string"), "_source": F.coalesce("_s", F.lit(""))})
    met = at.join(F.broadcast(slots), ["_null", "_source", "_turn"])
    start = F.col("_cycle") * len(plan)
    slot = start + F.col("_slot")
    return met.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], F.col("_block").alias("mix_block"), (start + F.col("_release")).alias("mix_release"), (start + F.col("_deadline")).alias("mix_deadline"), slot.alias("mix_slot"), (slot * block + F.col("_rank") % block).alias("mix_at"))
