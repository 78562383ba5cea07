"""Mixing sources to target weights, by DataFrame functions only.

Every document gets a hash-random key; documents are range-sorted by (source,
key); distributed prefix sums of their sizes tell how much of the source lies
before each of them, and the mix is cut at the source's exact budget.  A budget
above the source's size repeats it in whole epochs first.

Defined results: a null text has size 0, and very long ones count whole; a null
source is a source of its own, ordered last; sources of size 0 have target 0; an
empty table gives no rows; rows that repeat an id, or have none, are separate
rows, each cut by itself; rows that tie in key, id and size are interchangeable;
other columns are ignored by ``mix`` and returned by ``mixed_documents``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, plain_ids, saved, word_count
from .prefix import ranged_prefix

#: No source, and so no document, is used more often than this.
MAX_EPOCHS = 3


def source_targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs (whole passes) and rest (words of the last pass).

    Sources in code point order, null last, take ``weights`` in turn and share
    the total of all sizes.  A target stops at ``max_epochs`` times its
    source's size and the excess is shared again by weight until none is above
    (the water level at which the capped shares add up to the total).
    """
    by_name, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumns({
        "place": F.row_number().over(rising),
        "capped": F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole),
    })
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    s = s.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(whole)["level"])
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))))
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("source", "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """``docs`` (doc_id, source, text) -> doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of the document, repeats
    included: whole epochs, and in the last one the words before the cut, so a
    source's sum of ``taken`` is its rounded target.
    """
    sized = saved(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "mix-sized")
    targets = saved(source_targets(sized, weights, max_epochs).withColumnRenamed("source", "_source"), "mix-targets", True)
    keyed = sized.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    order = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("doc_id").asc(), F.col("size").asc()]
    placed = ranged_prefix(keyed, order, {"before": "size"}, "source", "mix")
    out = placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents of the mix: all columns of ``docs``, one row per copy.

    A document is given as often as its epochs say; the one at the cut comes
    once more if at least half of it lies before the cut.  Documents without
    words have no share to lose and stay once.
    """
    plain = plain_ids(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.struct(*docs.columns).alias("row")) if plain else keyed(docs, "mix-rows")
    sizes = rows.select(F.col("key").alias("doc_id"), "row.source", "row.text")
    share = mix(sizes, weights, max_epochs).select(F.col("doc_id").alias("id"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias("copies"))
    rows = rows.join(share.where("copies > 0"), F.col("key") == F.col("id"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
