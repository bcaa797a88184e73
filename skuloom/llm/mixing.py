"""Mixing sources to target weights by weighted fair queueing.

Each document gets a virtual finish time: the words of its source up to and including it (in
shuffled order), divided by the source's weight. Serving documents by finish time gives every
source words in proportion to its weight; a source that was served ``MAX_REPEATS`` times drops
out and the others share what it leaves. The mix is the longest prefix within the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skuloom.llm.common import free_name, pick, position_of, positions
from skuloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
MAX_REPEATS = 2
# ranges of virtual time of which one is sorted to find the cut, and parts of a source that
# are summed apart
RANGES = 4096


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """Order of the documents of a source; equal only for rows equal in id and text."""
    return F.md5(
        F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary")
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent=BUDGET_PERCENT, repeats=MAX_REPEATS) -> DataFrame:
    """(source, source_size, rank, scale, target) from (source, source_size).

    One row per source goes in, which is far less than the documents. ``scale`` is the
    least common multiple of the weights over the source's weight, so that finish times are
    whole numbers. The level is where sum(min(repeats * size, weight * level)) is the budget.
    """
    common = math.lcm(*weights)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", place).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.col("source_size") * repeats).withColumn(
        "full_at", F.col("most") / F.col("weight")
    )
    by_level = Window.orderBy("full_at", "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * (budget_percent / 100)
    level = (budget - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level)
    reached = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))
    leveled = leveled.withColumn("level", F.min(reached).over(everything)["level"])
    return leveled.select(
        "source",
        "source_size",
        "rank",
        (F.lit(common) / F.col("weight")).cast("long").alias("scale"),
        F.when(F.col("level") * F.col("weight") < F.col("most"), F.col("level") * F.col("weight"))
        .otherwise(F.col("most").cast("double"))
        .alias("target"),
    )


def _queue(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (source, key, size, ..) with ``done``: words of the source up to and including the
    row in shuffled order, and ``same``: the number of the row among those with its key, by
    source.

    A source is cut into ranges of the key, summed first, so that no task sees a whole source.
    """
    rows = rows.withColumn("part", F.substring("key", 1, 3))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("source").alias("o_source"),
        F.col("part").alias("o_part"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    joined = rows.join(offsets, rows["source"].eqNullSafe(F.col("o_source")) & (F.col("part") == F.col("o_part")))
    inside = Window.partitionBy("source", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    queued = joined.withColumn("done", F.col("offset") + F.sum("size").over(inside))
    known = targets.select(
        F.col("source").alias("t_source"), "source_size", "rank", "scale", "target"
    )
    queued = queued.join(known, F.col("source").eqNullSafe(F.col("t_source")))
    equal = Window.partitionBy("key").orderBy("rank", "done")
    return queued.withColumn("same", F.row_number().over(equal)).drop(
        "o_source", "o_part", "t_source", "offset", "part"
    )


def _taken(queued: DataFrame, budget_percent: int, repeats: int) -> DataFrame:
    """``queued`` with ``taken``: the words of the row's copies before the cut.

    Only single numbers and the cut itself come to the driver.
    """
    finish = lambda copy: (F.col("done") + F.col("source_size") * copy) * F.col("scale")
    copies = F.explode(F.array(*[F.struct(F.lit(c).alias("copy"), finish(c).alias("finish")) for c in range(repeats)]))
    each = queued.select("rank", "key", "size", copies.alias("c")).select("rank", "key", "size", "c.copy", "c.finish")
    total, last = queued.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.max(F.col("source_size") * F.col("scale") * repeats)
    ).first()
    budget = total * budget_percent // 100
    # a range per 1/RANGES of the last finish time
    each = each.withColumn("range", F.expr(f"finish div {(last or 0) // RANGES + 1}"))
    sums = each.groupBy("range").agg(F.sum("size").alias("words"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("words").over(upto))
    # the first range that goes beyond the budget, and what may still be taken in it
    crossed = sums.where(F.col("upto") > budget).orderBy("range").first()
    if crossed is None:
        before = [F.lit(True)] * repeats
    else:
        left = budget - (crossed["upto"] - crossed["words"])
        order = Window.partitionBy("range").orderBy("finish", "rank", "key", "copy").rowsBetween(Window.unboundedPreceding, 0)
        edge = each.where(F.col("range") == crossed["range"]).withColumn("run", F.sum("size").over(order))
        cut = edge.where(F.col("run") > left).agg(F.min(F.struct("finish", "rank", "key", "copy")).alias("cut")).first()[0]
        end = F.struct(*[F.lit(cut[n]).cast(each.schema[n].dataType).alias(n) for n in ("finish", "rank", "key", "copy")])
        before = [
            F.struct(finish(c).alias("finish"), "rank", "key", F.lit(c).alias("copy")) < end for c in range(repeats)
        ]
    amount = sum((F.when(b, F.col("size")).otherwise(F.lit(0)) for b in before), F.lit(0))
    return queued.withColumn("taken", amount.cast("long"))


def _mix(plain: DataFrame, doc_id: str, text: str, source: str, weights, budget_percent, repeats) -> DataFrame:
    rows = plain.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        shuffle_key(F.col(doc_id), F.col(text)).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = materialize(rows, "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    queued = materialize(_queue(rows, source_targets(sizes, weights, budget_percent, repeats)), "mix-queue")
    return _taken(queued, budget_percent, repeats)


def mix(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    Sources in code point order (null last) take the weights in turn. The budget is
    ``budget_percent`` of all words; a source gives its words ``repeats`` times at most and a
    document is taken whole, so taken is a multiple of its size.

    Null texts have size 0 and take nothing. Null ids and sources are values like others;
    repeated rows are queued one after the other. The order depends on id and text only, so
    reruns agree. An empty table gives no rows. Further columns are ignored.
    """
    rows = pick(documents, id_column, text_column, source_column).toDF("doc_id", "text", "source")
    mixed = _mix(rows, "doc_id", "text", "source", weights, budget_percent, repeats)
    return mixed.select(F.col("doc_id").alias(id_column), "size", "source_size", "target", "taken")


def draw(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = MAX_REPEATS,
    copies_column: str = "copies",
) -> DataFrame:
    """The documents (all columns) that the mix takes, with the number of copies in
    ``copies_column`` (with underscores after the name if there is such a column).

    Documents without words, so also those with null or empty texts, cost nothing and are left out.
    Null ids and sources, repeated rows and long texts count as in ``mix``. An empty table stays empty.
    """
    names, plain = documents.columns, positions(documents)
    at = [f"c{position_of(documents, n)}" for n in (id_column, text_column, source_column)]
    mixed = _mix(plain, *at, weights, budget_percent, repeats).where(F.col("taken") > 0).select(
        F.col("key").alias("m_key"), F.col("same").alias("m_same"), (F.col("taken") / F.col("size")).cast("int").alias("copies")
    )
    keyed = plain.withColumn("key", shuffle_key(F.col(at[0]), F.col(at[1])))
    # equal rows are interchangeable; they are numbered to keep their count
    equal = Window.partitionBy("key").orderBy(F.col(at[2]).asc_nulls_last())
    numbered = keyed.withColumn("same", F.row_number().over(equal))
    # the numbers are compared by two inequalities, so that the join uses the placement by key
    match = (F.col("key") == F.col("m_key")) & (F.col("same") >= F.col("m_same")) & (F.col("same") <= F.col("m_same"))
    return numbered.join(mixed, match).select(*plain.columns, "copies").toDF(*names, free_name(documents, copies_column))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][rnk % 3 + 1] AS weight, 2 * source_size AS most, 2 * source_size / [5, 2, 1][rnk % 3 + 1] AS full_at FROM s),
v AS (
  SELECT *, (1.5 * (SELECT sum(source_size) FROM s)
             - coalesce(sum(most) OVER (ORDER BY full_at, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY full_at, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
  FROM w),
t AS (
  SELECT source, source_size, rnk, weight,
         least(CAST(most AS DOUBLE), weight * (SELECT arg_min(lv, full_at) FROM v WHERE lv <= full_at)) AS target
  FROM v),
q AS (
  SELECT d.doc_id, d.key, d.size, t.source_size, t.target, t.rnk,
         CAST(sum(d.size) OVER (PARTITION BY t.rnk ORDER BY d.key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS done,
         10 // t.weight AS scale, row_number() OVER () AS rid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT q.rid, q.size, sum(q.size) OVER (ORDER BY (done + source_size * k) * scale, rnk, key, k ROWS UNBOUNDED PRECEDING) AS run
  FROM q, (VALUES (0), (1)) AS copies(k)),
g AS (SELECT rid, sum(size) AS taken FROM c WHERE run <= (SELECT sum(size) FROM q) * 150 // 100 GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(g.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g USING (rid)
"""
