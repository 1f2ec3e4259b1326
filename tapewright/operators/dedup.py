"""Messages delivered at least once: exactly one copy of each identifier is kept.

Method: identifiers are dictionary-encoded exactly (shard by hash, dense code inside the shard), seen codes
are held as compressed bitmaps per (shard, bucket of 32,768 codes), one arrival is selected per unseen
bit, and the new bits are united with the stored ones by an atomic switch to a new version of the state.

A version holds what one batch added: the arrivals it kept with their codes, and its new bits. Nothing older is
rewritten. The list of versions in force is a numbered manifest, made by a rename that fails if the number is
taken: kept rows, dictionary and bits come into force together or not at all, and of two writers that started from the same
state one is refused.

Grouping by identifier combines on the map side, and the rows left out are found by a join on the unique
message number, so copies of one message may make up any share of the input.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewright.functions.common import require_columns, work_path

#: Codes in one bitmap, as Spark's bitmap functions have it.
BITS = 32_768
#: Versions in force after which ``compact`` is due.
COMPACT_AFTER = 16


class StateChanged(RuntimeError):
    """Another writer committed since the state was read. Load it again and repeat the batch."""


@dataclass(frozen=True)
class SeenState:
    """The versions in force below ``root`` ({name: label of its batch}), as of manifest ``number`` (0: none yet)."""

    root: str
    number: int
    shards: int
    versions: dict[str, str]

    def arrivals(self, spark: SparkSession, only: str | None = None) -> DataFrame | None:
        """Identifiers with their codes and the message kept of each; of one version, or of all."""
        names = [v for v in self.versions if only in (None, v)]
        return spark.read.parquet(*[f"{self.root}/{v}/arrivals" for v in names]) if names else None

    def bitmaps(self, spark: SparkSession) -> DataFrame | None:
        """``_shard``, ``_bucket``, ``seen``: the bits of all versions united."""
        if not self.versions:
            return None
        parts = spark.read.parquet(*[f"{self.root}/{v}/bitmaps" for v in self.versions])
        return parts.groupBy("_shard", "_bucket").agg(F.bitmap_or_agg("seen").alias("seen"))


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def load_state(spark: SparkSession, root: str, shards: int = 1024) -> SeenState:
    """The state in force below ``root``; an empty one before the first commit."""
    path, fs = _files(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = [int(n.removeprefix("manifest-")) for n in found if n.startswith("manifest-")]
    if not numbers:
        return SeenState(root, 0, shards, {})
    head, *rows = [r[0] for r in spark.read.text(f"{root}/manifest-{max(numbers):08d}", wholetext=True).collect()][0].splitlines()
    return SeenState(root, max(numbers), int(head), dict(r.split("\t", 1) for r in rows))


def _switch(spark: SparkSession, state: SeenState, versions: dict[str, str]) -> SeenState:
    """Bring ``versions`` into force by one rename that fails if someone else was first."""
    _, fs = _files(spark, state.root)
    jvm = spark._jvm
    made = jvm.org.apache.hadoop.fs.Path(f"{state.root}/next-{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray("\n".join([str(state.shards), *[f"{v}\t{label}" for v, label in versions.items()]]).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(made, jvm.org.apache.hadoop.fs.Path(f"{state.root}/manifest-{state.number + 1:08d}"), keep)
    except Exception as e:
        fs.delete(made, False)
        if "AlreadyExists" in str(e):
            raise StateChanged(f"{state.root} is past version {state.number}") from e
        raise
    return SeenState(state.root, state.number + 1, state.shards, versions)


def _codes(rows: DataFrame, ids: list[str], state: SeenState) -> DataFrame:
    """One row per identifier of the batch: ``_shard``, ids, ``_m`` (lowest message), ``code`` and ``_old`` (whether the dictionary had it)."""
    spark = rows.sparkSession
    shard = F.pmod(F.xxhash64(*ids), F.lit(state.shards)).cast("int")
    arrivals = rows.groupBy(shard.alias("_shard"), *ids).agg(F.min("_m").alias("_m"))
    words = state.arrivals(spark)
    if words is None:
        known, fresh = None, arrivals.withColumn("_base", F.lit(0).cast("long"))
    else:
        both = arrivals.join(words.filter("fresh").select("_shard", *ids, "code"), ["_shard", *ids], "left")
        known = both.filter("code is not null").withColumn("_old", F.lit(True))
        base = words.groupBy("_shard").agg((F.max("code") + 1).alias("_base"))
        fresh = both.filter("code is null").drop("code").join(F.broadcast(base), "_shard", "left")  # a row per shard, whose number is a setting
    # Identifiers that are new to the dictionary get the next codes of their shard, in order.
    order = Window.partitionBy("_shard").orderBy(*ids)
    fresh = fresh.select("_shard", *ids, "_m", (F.coalesce("_base", F.lit(0)) + F.row_number().over(order) - 1).cast("long").alias("code"), F.lit(False).alias("_old"))
    return fresh if known is None else known.select(*fresh.columns).unionByName(fresh)


def _unseen(coded: DataFrame, bitmaps: DataFrame | None) -> DataFrame:
    """The rows whose bit isn't set. A code that was given out in this batch lies beyond all stored bits of its shard."""
    placed = coded.withColumn("_bucket", F.call_function("div", F.col("code"), F.lit(BITS)).cast("int")).withColumn("_bit", F.pmod("code", F.lit(BITS)).cast("int"))
    if bitmaps is None:
        return placed
    old = placed.filter("_old").join(bitmaps, ["_shard", "_bucket"], "left")
    byte = F.ascii(F.decode(F.substring("seen", F.call_function("div", F.col("_bit"), F.lit(8)).cast("int") + 1, F.lit(1)), "ISO-8859-1"))
    is_seen = F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8))) == 1, F.lit(False))
    return old.filter(~is_seen).drop("seen").select(*placed.columns).unionByName(placed.filter("not _old"))


def deliver(df: DataFrame, identifier: list[Column], message: str, state: SeenState, label: str | None = None) -> tuple[DataFrame, SeenState]:
    """One batch against ``state``: (message numbers kept, the state after it).

    Of each identifier whose bit is unset the lowest ``message`` is kept. What is kept is part of the committed version: a batch that
    fails before its commit leaves nothing behind and can be repeated; one that was committed under its ``label`` already gives
    the same messages again. Raises ``StateChanged`` if another writer committed since ``state`` was read.
    ``message`` must be unique. Rows with a null in any identifier part, or in the message, are no messages.
    """
    spark = df.sparkSession
    done = next((v for v, name in state.versions.items() if label and name == label), None)
    if done:
        return state.arrivals(spark, done).select("message"), state
    ids = [f"_id{i}" for i in range(len(identifier))]
    rows = df.select(*[c.alias(n) for c, n in zip(identifier, ids)], F.col(message).cast("long").alias("_m")).dropna()
    version = f"v-{uuid.uuid4().hex}"
    unseen = _unseen(_codes(rows, ids, state), state.bitmaps(spark))
    unseen.select("_shard", *ids, "code", "_bucket", "_bit", (~F.col("_old")).alias("fresh"), F.col("_m").alias("message")).write.parquet(f"{state.root}/{version}/arrivals", compression="zstd")
    new = spark.read.parquet(f"{state.root}/{version}/arrivals")
    bits = new.groupBy("_shard", "_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_bit") + 1)).alias("seen"))
    bits.write.parquet(f"{state.root}/{version}/bitmaps", compression="zstd")
    return new.select("message"), _switch(spark, state, {**state.versions, version: label or version})


def compact(spark: SparkSession, state: SeenState) -> SeenState:
    """All versions written as one; labels of their batches are given up, so only batches that will not come again may be in it."""
    version = f"v-{uuid.uuid4().hex}"
    if len(state.versions) < 2:
        return state
    state.arrivals(spark).write.parquet(f"{state.root}/{version}/arrivals", compression="zstd")
    state.bitmaps(spark).write.parquet(f"{state.root}/{version}/bitmaps", compression="zstd")
    return _switch(spark, state, {version: version})


def deliver_once(df: DataFrame, identifier: list[Column], message: str, root: str | None = None, shards: int = 1024, batches: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, repeated) rows of ``df``: one copy of each identifier, and all further copies.

    ``df`` is read as a log in order of ``message``, in ``batches`` segments of about equal length; each is delivered against the state
    that the ones before committed. With ``root`` the identifiers seen in earlier calls count too; without,
    the state lives as long as the shared folder. The lowest ``message`` of an identifier is kept. Rows with a null
    in an identifier part are never copies and are all kept. An empty table gives empty results; columns of
    ``df`` pass through unchanged, whatever their names.
    """
    require_columns(df, [message])
    spark = df.sparkSession
    state = load_state(spark, root or work_path(spark, "seen"), shards)
    cuts = []
    if batches > 1:
        cuts = sorted({int(x) for x in df.agg(F.percentile_approx(F.col(message).cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] or []})
    place = F.col(message)
    chosen = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        segment = df
        if low is not None:
            segment = segment.filter(place > low)
        if high is not None:
            segment = segment.filter(place <= high)
        kept, state = deliver(segment, identifier, message, state)
        chosen.append(kept)
        if len(state.versions) > COMPACT_AFTER:
            state = compact(spark, state)
    chosen = reduce(DataFrame.unionByName, chosen).select(F.col("message").alias("_tw_message"))
    known = F.lit(True)
    for c in identifier:
        known = known & c.isNotNull()
    known = known & place.isNotNull()
    whole = df.filter(known)
    kept = whole.join(chosen, whole[message] == chosen["_tw_message"], "left_semi").unionByName(df.filter(~known))
    repeated = whole.join(chosen, whole[message] == chosen["_tw_message"], "left_anti")
    return kept, repeated
