"""Mix sources to target weights, cutting each source exactly at its budget of words.

Documents get a hash-random key that doesn't change between runs. Within a source they stand in the
order of that key, and a document takes words as long as the words before it leave room. The
running totals are built in two steps, totals of key ranges first, so no source is ever sorted by
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyspark.llm.base import query, table
from studyspark.operators.lineage import cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
# Rows that one task sorts at a time, on average.
RANGE_ROWS = 5_000


def count_words(text: Column) -> Column:
    return F.coalesce(
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint")
    )


def random_key(doc_id: Column, text: Column) -> Column:
    """32 hex digits, uniform over documents and the same in every run. A null id counts as empty
    text; the text only parts rows that share an id."""
    return F.md5(
        F.concat_ws(
            "/",
            F.coalesce(doc_id.cast("string"), F.lit("")),
            F.md5(F.coalesce(text, F.lit("")).cast("binary")),
        ).cast("binary")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int
) -> DataFrame:
    """`sizes` (source, source_size) with each source's `target`.

    Weights go round the sources in code-point order, null last. The budget, `share` of all sizes,
    is split by weight; what exceeds `max_epochs` times a source's size goes to the others by
    weight until no source is above its cap. One row per source is all that is sorted here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    pick = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    listed = cut(
        sizes.withColumn("weight", pick).withColumn(
            "top", F.col("source_size") * F.lit(float(max_epochs))
        )
    )
    budget = share * float(listed.agg(F.sum("source_size")).first()[0] or 0)
    # the level at which min(top, level * weight) adds up to the budget; it only rises
    level, settled = 0.0, False
    while not settled:
        full = F.col("top") <= F.lit(level) * F.col("weight")
        taken, left = listed.agg(
            F.sum(F.when(full, F.col("top"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not left:
            level = float("inf")
            break
        rise = (budget - (taken or 0.0)) / left
        settled, level = rise <= level, max(rise, level)
    target = F.col("top") if level == float("inf") else F.least("top", F.lit(level) * F.col("weight"))
    return listed.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Rows (row, size, source_size, target, taken); `row` holds all columns of `docs`, or only
    those that `carry` lists, so that texts need not be moved where only the plan is wanted.

    `taken` is the number of words the mix takes from a document over all epochs. Each source's
    words add up to its target rounded down to whole words; the document at the cut gives part of
    its words. Null text has size 0 and gives nothing; null is a source of its own; rows with one
    id stay apart unless their texts are equal too, and those may take each other's place. An empty
    table gives no rows.
    """
    kept = docs.columns if carry is None else list(carry)
    rows = cut(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
            F.struct(F.col(source_col).cast("string").alias("source")).alias("part"),
            count_words(F.col(text_col)).alias("size"),
            random_key(F.col(id_col), F.col(text_col)).alias("key"),
        )
    )
    total = rows.count()
    ranges = max(1, total // RANGE_ROWS)
    sizes = rows.groupBy("part.source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_epochs).select(
        F.struct("source").alias("part"), "source_size", "target"
    )
    spot = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("bigint") * ranges / (1 << 28))
    rows = rows.withColumn("spot", spot)
    blocks = rows.groupBy("part", "spot").agg(F.sum("size").alias("block"))
    ahead = Window.partitionBy("part").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("ahead", F.coalesce(F.sum("block").over(ahead), F.lit(0)))
        .join(targets, "part")
        .select("part", "spot", "ahead", "source_size", "target")
    )
    inner = (
        Window.partitionBy("part", "spot")
        .orderBy("key")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    # floor with a little slack, so a whole number that came out a hair low isn't cut by one
    words = F.floor(F.col("target") + F.lit(1e-6))
    laps = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0)
    rest = words - laps * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return (
        rows.join(blocks, ["part", "spot"])
        .withColumn("before", before)
        .select(
            "row",
            "size",
            "source_size",
            "target",
            (laps * F.col("size") + last).cast("bigint").alias("taken"),
        )
    )


def _oracle() -> str:
    w = ", ".join(f"{float(x)}" for x in WEIGHTS)
    return f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || md5(coalesce(text, ''))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * {float(MAX_EPOCHS)} AS top,
         [{w}][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)}]
           AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(top) OVER a AS full_top, sum(weight) OVER b AS open_weight,
         {SHARE} * sum(source_size) OVER () AS budget
  FROM s
  WINDOW a AS (ORDER BY top / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (ORDER BY top / weight DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT arg_min((budget - (full_top - top)) / open_weight, top / weight) AS level FROM o
      WHERE (budget - (full_top - top)) / open_weight <= top / weight),
t AS (SELECT source, source_size, least(top, level * weight) AS target FROM s, v),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         floor(t.target + 1e-6) AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(words / source_size) ELSE 0 END AS laps FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(laps * size + least(greatest(words - laps * source_size - before, 0), size) AS BIGINT)
         AS taken
FROM e"""


@query(_oracle())
def op4_mix_sources(spark, folder):
    mixed = mix_sources(table(spark, folder, "documents"), carry=["doc_id"])
    target = F.round("target", 6).alias("target")
    return mixed.select(F.col("row.doc_id"), "size", "source_size", target, "taken")
