"""Exact dedup by a heavy-hitter split.

1. Every row becomes (doc_id, SHA-256 of its text, a tag of the row), written once.
2. Misra-Gries counters (``freqItems``, at most ``1 / support`` of them) find every digest that holds
   more than ``support`` of the rows, however skewed the table is.
3. A second pass counts those candidates exactly and finds their winners; that table has at most
   ``1 / support`` rows, so it is broadcast, and rows of frequent digests are decided map-side.
4. All other digests have fewer than ``support`` of the rows each and are shuffled in the ordinary way.

Defined cases: a null text counts as the empty text; null ids come before all others, so such a row
stays only in a group without ids; of rows that repeat id and text exactly one stays (the first by its JSON,
whatever types its columns have); an empty table
gives an empty table; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.llm.store import materialize


def digest(text_col: str = "text"):
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """One row per input row: doc_id, digest, row_tag, keep_id, group_size, kept."""
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"), digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row_tag")
        ),
        "digests",
    )
    best = F.max(F.struct("doc_id", "row_tag"))
    candidates = slim.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = materialize(
        slim.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(best.alias("best"), F.count("*").alias("group_size")),
        "frequent",
    )
    told = slim.join(F.broadcast(winners), "digest", "left")  # at most 1 / support rows
    heavy = told.filter(F.col("group_size").isNotNull())
    same = Window.partitionBy("digest")
    light = (
        told.filter(F.col("group_size").isNull())
        .select("digest", "doc_id", "row_tag")
        .withColumn("best", best.over(same))
        .withColumn("group_size", F.count("*").over(same))
    )
    return heavy.select(*light.columns).unionByName(light).select(
        "doc_id",
        "digest",
        "row_tag",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_tag") == F.col("best.row_tag")).alias("kept"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 1e-3) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only dropped (id, digest) pairs are joined back, by a left anti join that Spark broadcasts when their
    table is small. Rows that repeat both id and text share such a key; of those, one stays.
    """
    told = materialize(exact_groups(docs, id_col, text_col, support), "exact")
    gone = told.filter(~F.col("kept")).select("doc_id", "digest")
    stays = told.filter("kept").select("doc_id", "digest")
    twice = materialize(gone.join(stays, (gone.doc_id.eqNullSafe(stays.doc_id)) & (gone.digest == stays.digest), "left_semi").distinct(), "repeated")
    whole = docs.select(F.struct(F.col("*")).alias("r"), F.col(id_col).alias("i"), digest(text_col).alias("d"))
    match = lambda x: (F.col("i").eqNullSafe(x["doc_id"])) & (F.col("d") == x["digest"])
    once = whole.join(gone.distinct(), match(gone), "left_anti").select("r")
    if twice.isEmpty():
        return once.select("r.*")
    # a row whose id and text are repeated: its copies were all joined away above, one comes back
    back = whole.join(twice, match(twice), "left_semi").groupBy("i", "d").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r")
    return once.unionByName(back).select("r.*")
