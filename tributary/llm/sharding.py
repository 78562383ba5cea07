"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Linked documents start in a shard by
hash; in each round every one looks at the shards of its group, and asks for the
one that holds most of the group's bytes among those with room, if that holds
more than its own.  A shard accepts requests while its quota, an even share of
all bytes, lasts; a full one is passed over from then on, so members that it
could not take ask for the next best.  Rounds end when nobody asks any more
(``ROUNDS`` at most).  Unlinked documents then fill what each shard lacks.  A
last pass lines up documents by shard, unlinked ones at both ends of each shard,
and cuts the line of bytes into equal parts: it moves few documents, and mostly
unlinked ones, and leaves sizes within one document of each other.

Defined results: a null text is an empty one and has size 16; very long texts
count whole; a group larger than a shard is spread over as many as it needs, as
a quota never yields; an empty table gives no rows; repeated rows are separate
rows of one group; ties between shards go to the smaller number; null ids hash
as a value of their own; ``shard`` ignores other columns, ``sharded`` returns
all columns, whatever their names, but for ones called shard or slot, which give
way to the operator's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, keyed, saved
from .prefix import ranged_prefix

ROUNDS, BUCKETS = 12, 1024


def propagate(linked: DataFrame, capacity: float, n_shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Move rows of ``linked`` (node, grp, size, shard) towards their groups' shards.

    Quotas are kept exactly: requests fall into ``BUCKETS`` hash buckets per shard, and a shard
    accepts the leading buckets whose sum fits.  The driver sees one number per
    shard and bucket, never a document.
    """
    state = saved(linked, "shard-state", True)
    full: set[int] = set()
    for step in range(rounds):
        load = loads(state)
        room = {s: capacity - load.get(s, 0) for s in range(n_shards)}
        free = F.element_at(F.array(*[F.lit(s not in full) for s in range(n_shards)]), F.col("shard") + 1)
        held = saved(state.groupBy("grp", "shard").agg(F.sum("size").alias("held")), "shard-held", True)
        best = held.where(free).groupBy("grp").agg(F.max(F.struct("held", -F.col("shard"), "shard")).alias("best"))
        # what each shard of a group asks for; written before rows join it, so that a group with most rows can be split
        goal = held.join(best, "grp").where((F.col("shard") != F.col("best.shard")) & (F.struct("held", -F.col("shard")) < F.struct(F.col("best.held"), -F.col("best.shard"))))
        goal = saved(goal.select("grp", "shard", F.col("best.shard").alias("goal")), "shard-goal", True)
        asked = state.join(goal, ["grp", "shard"], "left").withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(step)), F.lit(BUCKETS)).cast("int"))
        wanted = asked.where("goal is not null").groupBy("goal", "bucket").agg(F.sum("size").alias("n")).collect()
        limit, refused = [0] * n_shards, False
        for r in sorted(wanted, key=lambda r: (r["goal"], r["bucket"])):
            s = r["goal"]
            if s in full or room[s] < r["n"]:
                full.add(s)
                refused = True
            else:
                room[s] -= r["n"]
                limit[s] = r["bucket"] + 1
        if any(limit):
            may = F.col("goal").isNotNull() & (F.col("bucket") < F.element_at(F.array(*[F.lit(x) for x in limit]), F.coalesce("goal", F.lit(0)) + 1))
            moved = saved(asked.withColumn("shard", F.when(may, F.col("goal")).otherwise(F.col("shard"))).select(*linked.columns), "shard-state", True)
            drop_saved(state)
            state = moved
        drop_saved(held, goal)
        if not any(limit) and not refused:
            break
    return state


def loads(df: DataFrame) -> dict[int, int]:
    """Bytes by shard."""
    return {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.sum("size").alias("n")).collect()}


def fill(single: DataFrame, load: dict[int, int], total: int, n_shards: int) -> DataFrame:
    """Give unlinked rows to shards so that each comes near an even share of ``total``."""
    lack = [max(0.0, total / n_shards - load.get(s, 0)) for s in range(n_shards)]
    ends, at = [], 0.0
    for x in lack[:-1]:
        ends.append(at := at + x)
    middle = F.col("bytes_before") + F.col("size") / 2
    place = F.aggregate(F.array(*[F.lit(x) for x in ends]), F.lit(0), lambda n, e: n + (middle >= e).cast("int")) if ends else F.lit(0)
    placed = ranged_prefix(single, [F.col("node").asc(), F.col("doc_id").asc(), F.col("size").asc()], {"bytes_before": "size"}, None, "shard-fill")
    return placed.withColumn("shard", place.cast("int")).drop("bytes_before")


def shard(docs: DataFrame, n_shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, size, text_crc32, shard, slot, grp (digest of the text), linked."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    nodes = saved(docs.select("doc_id", (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("grp"), F.xxhash64("doc_id", F.lit("node")).alias("node"), F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int").alias("shard")), "shard-nodes")
    # groups and goals are written before they are joined: adaptive execution can then split a group that holds most documents
    groups = saved(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp"), "shard-groups", True)
    marked = saved(nodes.join(groups.withColumn("linked", F.lit(True)), "grp", "left").withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-marked", True)
    single = marked.where("not linked")
    total = nodes.agg(F.sum("size").alias("n")).first()["n"] or 0
    settled = propagate(marked.where("linked"), total / n_shards, n_shards, rounds)
    zone = F.when(F.col("linked"), 1).when(F.col("node") % 2 == 0, 0).otherwise(2)
    line = settled.unionByName(fill(single, loads(settled), total, n_shards)).withColumns({"zone": zone, "one": F.lit(1)})
    order = [F.col(c).asc() for c in ("shard", "zone", "grp", "doc_id", "node")]
    placed = ranged_prefix(line, order, {"bytes_before": "size", "rows_before": "one"}, None, "shard")
    place = F.floor((F.col("bytes_before") * 2 + F.col("size")) * n_shards / (2 * max(total, 1)))
    placed = saved(placed.withColumn("shard", F.least(place, F.lit(n_shards - 1)).cast("int")), "shard-placed", True)
    first = [0] * n_shards
    for r in placed.groupBy("shard").agg(F.min("rows_before").alias("n")).collect():
        first[r["shard"]] = r["n"]
    slot = F.col("rows_before") - F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), F.hex("grp").alias("grp"), "linked")


def sharded(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """The rows of ``docs``, all columns, with their shard and slot.

    Rows travel under a number of their own, as ids may repeat.
    """
    rows = keyed(docs, "shard-rows")
    found = shard(rows.select(F.col("key").alias("doc_id"), F.col("row.text").cast("string").alias("text")), n_shards).select(F.col("doc_id").alias("key"), "shard", "slot")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return rows.join(found, "key").select(*kept, "shard", "slot")
