"""Secret scans through an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger has, for each blob, the rule versions
it was scanned with and the spans they found. A run scans only pairs of blob and rule version that
the ledger lacks, each blob once whatever the number of its paths, and joins spans back to all paths.

Spark's functions give matches but not their places, so a place is a running sum: the pieces that a
rule's pattern splits the text into, and the matches between them, alternate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studyspark.llm.base import query, table
from studyspark.operators.keyed import attach
from studyspark.operators.lineage import cut

# A list of unseen blobs up to this size is broadcast, so that texts seen before aren't shuffled.
BROADCAST_BLOBS = 500_000


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has `least` characters.

    A change of a rule needs a new `version`, so that blobs are scanned anew for it.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds that every scan must report. For access and hex, runs too short can't hide
# a longer match, so their length stands in the pattern and short ones are never listed.
BASE_RULES = (
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
RULES = (
    *BASE_RULES,
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{30,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\x20\\x09-\\x0D]*"),
    Rule("login", 1, r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)

LEDGER = (
    "blob string, scanned array<string>, "
    "spans array<struct<start: bigint, kind: string, version: int, end: bigint>>"
)


def blob_of(text: Column) -> Column:
    """Content address of a text; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Ledger rows of blobs (blob, text, todo); `todo` lists the keys of the rules to apply.

    Rows must differ by `blob`. Nothing here needs another shuffle where they are parted by it.
    """
    nothing = F.array().cast("array<string>")
    text = F.col("text")
    listed = blobs.select(
        "blob",
        "todo",
        "text",
        *[
            F.when(
                F.array_contains("todo", r.key), F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
            ).otherwise(nothing).alias(f"m{k}")
            for k, r in enumerate(rules)
        ],
    )

    def step(k: int, gap: Column, match: Column, good: Column) -> Column:
        return F.struct(
            F.lit(k).alias("rule"),
            F.length(gap).cast("bigint").alias("gap"),
            F.length(match).cast("bigint").alias("len"),
            good.alias("good"),
        )

    def steps(k: int, r: Rule) -> Column:
        def one(gap, match):
            held = match if r.group == 0 else F.regexp_extract(match, r.pattern, r.group)
            return step(k, gap, match, F.length(held) >= r.least)

        found = F.zip_with(F.split(text, r.pattern, -1), F.col(f"m{k}"), one)
        return F.when(F.size(f"m{k}") > 0, found).otherwise(F.array())

    empty = F.lit("")
    # one row stands for the blob itself, so that blobs without a match are in the ledger too
    itself = F.array(step(-1, empty, empty, F.lit(False)))
    each = listed.select(
        "blob",
        "todo",
        F.posexplode(F.concat(itself, *[steps(k, r) for k, r in enumerate(rules)])).alias("at", "s"),
    ).where("s.len IS NOT NULL")
    walked = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    versions = F.array(*[F.lit(r.version) for r in rules])
    placed = each.select("blob", "todo", "at", "s.rule", "s.gap", "s.len", "s.good").withColumn(
        "end", F.sum(F.col("gap") + F.col("len")).over(walked)
    )
    span = F.struct(
        (F.col("end") - F.col("len")).alias("start"),
        F.col("rule"),
        F.get(kinds, F.col("rule")).alias("kind"),
        F.get(versions, F.col("rule")).alias("version"),
        F.col("end"),
    )
    return placed.groupBy("blob").agg(
        F.first("todo").alias("scanned"),
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("good"), span))),
            lambda s: F.struct(s["start"], s["kind"], s["version"], s["end"]),
        ).alias("spans"),
    ).select(F.col("blob"), F.col("scanned"), F.col("spans").cast(LEDGER.split("spans ")[1]).alias("spans"))


def unscanned(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
    broadcast_blobs: int = BROADCAST_BLOBS,
) -> DataFrame:
    """(blob, text, todo) of each blob of `versions` that some rule's version hasn't seen."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = versions.select(blob_of(text).alias("blob"), text.alias("text"))
    if ledger is None:
        # copies fold on the map side: a text that stands a million times is moved once per task
        return rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
    none = F.array().cast("array<string>")
    todo = F.array_except(wanted, F.coalesce("seen", none)).alias("todo")
    missing = cut(
        rows.select("blob").distinct().join(seen, "blob", "left").select("blob", todo).where(F.size("todo") > 0)
    )
    if missing.count() <= broadcast_blobs:
        rows = rows.join(F.broadcast(missing.select("blob")), "blob", "left_semi")
    return rows.groupBy("blob").agg(F.first("text").alias("text")).join(missing, "blob")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger in `folder`, or None where there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(
    versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, text_col: str = "text"
) -> DataFrame:
    """Scan what the ledger in `folder` lacks, add it there, and return the whole ledger.

    A run that dies adds nothing or repeats pairs at worst; readers fold repeated pairs. One run
    writes at a time.
    """
    spark = versions.sparkSession
    fresh = scan_blobs(unscanned(versions, read_ledger(spark, folder), rules, text_col), rules)
    fresh.write.mode("append").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def scan_secrets(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    text_col: str = "text",
) -> DataFrame:
    """(row, blob, spans) of every row of `docs`; `row` holds all its columns but the text.

    `spans` lists (start, kind, version, end) by start, then by the rules' order, in code points with
    exclusive ends. `ledger` may hold scans of earlier versions; without it each blob is scanned. Null
    text counts as empty and has no spans. Ids may be null or repeat and rows may be equal: each row
    gives one row. An empty table gives none. Spans of other rule versions are left out.
    """
    kept = [c for c in docs.columns if c != text_col]
    paths = cut(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), blob_of(F.col(text_col)).alias("blob")))
    fresh = scan_blobs(unscanned(docs, ledger, rules, text_col), rules)
    if ledger is None:
        known = fresh.select("blob", "spans")
    else:
        # a blob may have lines of several runs; pairs that a broken run repeated fold here
        order = {r.key: k for k, r in enumerate(rules)}
        place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
        listed = F.array_distinct(F.flatten(F.collect_list("spans")))
        current = F.filter(listed, lambda s: place[F.concat_ws("@", s["kind"], s["version"])].isNotNull())
        ranked = F.transform(
            current,
            lambda s: F.struct(s["start"], place[F.concat_ws("@", s["kind"], s["version"])].alias("rule"), s.alias("s")),
        )
        both = ledger.select("blob", "spans").unionByName(fresh.select("blob", "spans"))
        known = both.groupBy("blob").agg(
            F.transform(F.array_sort(ranked), lambda x: x["s"]).alias("spans")
        )
    # only blobs with findings are joined; a blob on a large part of all paths is salted
    known = cut(known.where(F.size("spans") > 0))
    none = F.array().cast(known.schema["spans"].dataType)
    return attach(paths, known, ["blob"]).withColumn("spans", F.coalesce("spans", none))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _oracle() -> str:
    found = []
    for k, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        held = f"length(regexp_extract(m, {p}, {r.group}))" if r.group else "length(m)"
        found.append(f"""
f{k} AS (SELECT rid, '{r.kind}' AS kind, {k} AS rule, finish - length(m) AS start, finish
         FROM (SELECT rid, m, i, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS finish
               FROM (SELECT rid, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
                     FROM (SELECT rid, regexp_extract_all(t, {p}) AS ms, regexp_split_to_array(t, {p}) AS gs FROM d)))
         WHERE {held} >= {r.least})""")
    union = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(RULES)))
    line = "string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rule)"
    base = f"rule < {len(BASE_RULES)}"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    zeros = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),{",".join(found)},
s AS ({union}),
a AS (SELECT rid, {counts}, {line} AS spans, {line} FILTER ({base}) AS base
      FROM s GROUP BY rid)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (rid)"""


@query(_oracle())
def op11_secret_scan(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = scan_secrets(docs)
    names = [r.kind for r in BASE_RULES]
    base = F.filter("spans", lambda s: s["kind"].isin(names))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        F.col("row.doc_id"),
        *[count(n).alias(f"n_{n}") for n in names],
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
