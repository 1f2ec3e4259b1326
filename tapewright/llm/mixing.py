"""Mixing sources to target weights.

Method: a low-discrepancy schedule of sources. The points of the van der Corput sequence are mapped through the cumulative
weights, so that at any moment each source has had its share of slots; slots are ranked per source, and the
r-th slot of a source takes the r-th of its blocks of equal tokens, from documents in shuffled order, starting over when they are
used up. Blocks grow with the corpus up to a bound, then their number does; slots are ranked and documents placed in blocks by
distributed running sums, so a source that holds a third of all documents is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions.common import with_positions

#: Slots a schedule has at most until blocks have reached ``MOST_BLOCK`` tokens; least and most tokens of a block. Beyond that the number of slots grows with the corpus.
SLOTS, LEAST_BLOCK, MOST_BLOCK = 65_536, 64, 1_000_000


@dataclass(frozen=True)
class Plan:
    """``tokens``: planned tokens of each source; ``block``: tokens of a block; ``status`` of each source."""

    tokens: dict[str, float]
    block: int
    status: dict[str, str]


def plan_mixture(targets: list[tuple[str, float, int]], available: dict[str, int], total: int | None = None, leave_out: float = 0.0) -> Plan:
    """How many tokens each source gives.

    Without ``total``: as many as let every source with documents reach its share within its repeats. A source
    with no documents gives none ('empty'); one that can't reach its share of the total gives all it may ('out of reach').
    ``leave_out`` (off by default): the scarcest sources, of at most this share of the target together, don't count for the total if without them it is more than four times as large.
    """
    limit = {s: available.get(s, 0) * max(r, 0) for s, _, r in targets}
    share = {s: w for s, w, _ in targets}
    usable = sorted((s for s in share if limit[s] > 0 and share[s] > 0), key=lambda s: limit[s] / share[s])
    if total is None:
        left, k = 0.0, 0
        while k + 1 < len(usable) and left + share[usable[k]] <= leave_out and 4 * limit[usable[k]] / share[usable[k]] < limit[usable[k + 1]] / share[usable[k + 1]]:
            left += share[usable[k]]
            k += 1
        total = limit[usable[k]] / share[usable[k]] if usable else 0
    tokens = {s: min(share[s] * total, float(limit[s])) for s in share}
    status = {s: "empty" if not limit[s] else "out of reach" if share[s] * total > limit[s] * (1 + 1e-9) else "reached" for s in share}
    return Plan(tokens, min(max(LEAST_BLOCK, int(sum(tokens.values()) // SLOTS)), MOST_BLOCK), status)


def schedule(spark: SparkSession, plan: Plan) -> DataFrame:
    """The slots in order: ``slot``, ``source``, ``rank`` (0-based, per source)."""
    whole = sum(plan.tokens.values())
    sources = sorted(s for s, t in plan.tokens.items() if t > 0)
    n = max(int(round(whole / plan.block)), 1) if whole > 0 else 0
    slots = spark.range(n).withColumnRenamed("id", "slot")
    # Van der Corput in base 2: the binary digits of the slot's number, mirrored at the point.
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), 31, "0")), 2, 10).cast("double") / float(2**31)
    upto, at = [], 0.0
    for s in sources:
        at += plan.tokens[s] / whole
        upto.append((s, at))
    choice = F.lit(sources[-1] if sources else None)
    for s, edge in reversed(upto[:-1]):
        choice = F.when(F.col("_u") < edge, F.lit(s)).otherwise(choice)
    chosen = slots.withColumn("_u", point).withColumn("source", choice.cast("string")).drop("_u")
    return with_positions(chosen, ["source"], ["slot"], F.shiftright("slot", 16)).select("slot", "source", F.col("_pos").alias("rank"))


def mix_sources(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, leave_out: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(copies per document, report per source).

    ``docs``: (doc_id, source, n_tokens), cheap to read twice (a written table); ``targets``: (source, target_share, max_repeats), a small
    table of settings. Copies: ``doc_id``, ``source``, ``n_tokens``, ``copies`` (0 to max_repeats), one row per document of a target
    source. Report: ``source``, ``target_share``, ``max_repeats``, ``available_tokens``, ``mixed_tokens``, ``actual_share``, ``status``.

    Defined results: documents of other sources or of none are no part; a document without tokens (or null) is placed like any other and adds
    nothing; a doc_id that occurs twice is two documents; no documents at all give shares of null; a target of share 0 gives no copies.
    """
    spark = docs.sparkSession
    rows = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select("source", "target_share", "max_repeats").collect() if r["source"] is not None]
    d = docs.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).filter(F.col("source").isin([s for s, _, _ in rows]))
    available = {r["source"]: int(r["t"]) for r in d.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    plan = plan_mixture(rows, available, total, leave_out)
    # Blocks: documents in shuffled order; a document is in the block that holds its middle.
    shuffled = d.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    placed = with_positions(shuffled, ["source"], ["_h", "doc_id", "n_tokens"], F.shiftright("_h", 52), F.col("n_tokens"))
    block = F.floor((F.col("_before") + F.col("n_tokens") / 2) / F.lit(float(plan.block))).cast("long")
    placed = placed.select("doc_id", "source", "n_tokens", block.alias("_block"))
    blocks = F.create_map(*[x for s, t in available.items() for x in (F.lit(s), F.lit(max(-(-t // plan.block), 1)).cast("long"))]) if available else F.create_map(F.lit(""), F.lit(1).cast("long"))
    repeats = F.create_map(*[x for s, _, r in rows for x in (F.lit(s), F.lit(r).cast("long"))]) if rows else F.create_map(F.lit(""), F.lit(0).cast("long"))
    n_blocks = blocks[F.col("source")]
    slots = schedule(spark, plan).filter(F.col("rank") < n_blocks * repeats[F.col("source")])
    used = slots.select(F.col("source").alias("_s"), F.pmod("rank", n_blocks).alias("_b")).groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("copies"))
    last = F.least(F.col("_block"), blocks[F.col("source")] - 1)
    placed = placed.withColumn("_block", last)
    copies = placed.join(used, (placed["source"] == used["_s"]) & (placed["_block"] == used["_b"]), "left").select("doc_id", "source", "n_tokens", F.coalesce("copies", F.lit(0)).cast("int").alias("copies"))
    mixed = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("n_tokens").alias("available_tokens"))
    settings = spark.createDataFrame([(s, w, r, plan.status[s]) for s, w, r in rows], "source string, target_share double, max_repeats int, status string")
    report = settings.join(mixed, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("mixed_tokens", "available_tokens")})
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", F.try_divide(F.col("mixed_tokens").cast("double"), whole).alias("actual_share"), "status")
    return copies, report
