"""Reading, standardising, rules and signal features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from studyspark.catalog.base import query, table, visits
from studyspark.functions.coerce import numeric_columns, text_columns
from studyspark.operators import rules, sessions, standardise
from studyspark.operators.lineage import shared_folder
from studyspark.sources.delimited import read_study
from studyspark.sources.records import ZSTD
from studyspark.sources.sinks import write_table


@query(
    """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
  'part-' AS file FROM customer"""
)
def csv_round_trip(spark, folder):
    """Write a table as delimited text, read it back, infer its types."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    write_table(table(spark, folder, "customer"), path, "csv")
    rows, _ = read_study(spark, [path])
    # the writer numbers its files; the name's beginning is the same in every run
    return rows.withColumn("file", F.substring("_source_file", 1, 5)).drop("_source_file")


# Level 12 leaves files of such lists no smaller; 19 does where ids are far apart, at a tenth of the speed or less.
ZSTD_LEVEL = 9
# One task reads a compressed file whole: this many lists are about 128 MB of text.
LISTS_PER_FILE = 2000


def write_lines(lines, heads, path, codec="none"):
    """Write the column `value` as text, with the header lines on top of each partition's own file.

    One file holds the header alone, so that a table without rows has one too.
    """
    head = F.lit("\n".join(heads))
    # the lower 33 bits number the rows of a partition
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    parts = lines.select(F.when(first, F.concat_ws("\n", head, "value")).otherwise(F.col("value")).alias("value"))
    alone = lines.sparkSession.range(0, 1, 1, 1).select(head.alias("value"))
    packed = {"compression": codec, "parquet.compression.codec.zstd.level": ZSTD_LEVEL}
    # apart from the rows: a union may put lines of a single partition and the lone header into one file
    alone.write.options(**packed).text(path)
    parts.write.mode("append").options(**packed).text(path)


@query(
    """SELECT event_id, user_id, '[' ||
  array_to_string([x + user_id for x in range(event_id % 7 + 10000)], ',') || ']' AS taps,
  CAST(NULL AS VARCHAR) AS note FROM events
WHERE event_type = 'signup'"""
)
def csv_long_lists(spark, folder):
    """Quoted lists of ten thousand numbers in rows that lack their last cell."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = table(spark, folder, "events").where("event_type = 'signup'").select("event_id", "user_id")
    # the ids are dealt out before they become lists, so nothing wide is shuffled
    e = e.repartition(e.count() // LISTS_PER_FILE + 1)
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 7 + 9999)
    taps = F.concat(
        F.lit('"['),
        F.array_join(F.transform(steps, lambda x: (x + F.col("user_id")).cast("string")), ","),
        F.lit(']"'),
    )
    line = F.concat_ws(",", "event_id", "user_id", taps)
    write_lines(e.select(line.alias("value")), ["event_id,user_id,taps,note"], path, ZSTD)
    rows, _ = read_study(spark, [path])
    return rows.select("event_id", "user_id", "taps", F.col("note").cast("string").alias("note"))


@query(
    """SELECT l_orderkey AS id, CAST(l_linenumber + 0.5 AS DOUBLE) AS vel, l_quantity AS step_mean, l_discount AS step_sd,
  l_extendedprice AS stride_mean, l_tax AS stride_sd FROM lineitem WHERE l_linenumber <= 7"""
)
def two_row_headers(spark, folder):
    """An export with sub-headers on its second line."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    line = table(spark, folder, "lineitem").where("l_linenumber <= 7")
    cells = ["l_orderkey", F.col("l_linenumber") + 0.5, "l_quantity", "l_discount", "l_extendedprice", "l_tax"]
    text = line.select(F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cells]).alias("value"))
    write_lines(text, ["ID,Vel,Step,,Stride,", ",,Mean,SD,Mean,SD"], path)
    rows, _ = read_study(spark, [path])
    return rows.drop("_source_file")


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind,
  event_type = 'error' AS rejected FROM events"""
)
def csv_long_rows(spark, folder):
    """Rows with one cell too many are kept aside; all others are read."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    e = table(spark, folder, "events").select(
        "event_id",
        # an unquoted comma makes a fourth cell
        F.when(F.col("event_type") == "error", F.lit("error,extra"))
        .otherwise(F.col("event_type"))
        .alias("kind"),
        "user_id",
    )
    e.write.option("header", True).option("quote", "").csv(path)
    rows, rejects = read_study(spark, [path])
    good = rows.select(F.col("event_id").cast("bigint").alias("event_id"), "kind", F.lit(False).alias("rejected"))
    bad = rejects.select(
        F.split("line", ",")[0].cast("bigint").alias("event_id"),
        F.lit(None).cast("string").alias("kind"),
        F.lit(True).alias("rejected"),
    )
    return good.unionByName(bad)


@query(
    """SELECT o_orderkey AS order_key, o_custkey AS total_price, o_totalprice AS total_price_1,
  o_orderstatus AS col_3 FROM orders"""
)
def normalised_names(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("  Order  Key! "),
        F.col("o_custkey").alias("Total (price)"),
        F.col("o_totalprice").alias("total__price"),
        F.col("o_orderstatus").alias("%%"),
    )
    return standardise.normalise_columns(o)


@query(
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment
FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier"""
)
def union_mixed(spark, folder):
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("balance"),
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
    )
    return standardise.concat_rows([c, s])


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS subject, CAST(o_orderkey AS DOUBLE) AS amount FROM orders
UNION ALL SELECT event_type, value FROM events"""
)
def union_type_conflict(spark, folder):
    """bigint with text meets in text, bigint with double in double."""
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("amount")
    )
    e = table(spark, folder, "events").select(
        F.col("event_type").alias("subject"), F.col("value").alias("amount")
    )
    return standardise.concat_rows([o, e])


TEXTS = """WITH t AS (SELECT
  CAST(value AS VARCHAR) AS amount,
  CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS code,
  CASE WHEN event_type = 'view' THEN 'unknown' ELSE strftime(ts, '%Y-%m-%d') END AS seen,
  CASE WHEN event_type = 'click' THEN CAST(user_id AS VARCHAR) END AS rare,
  props FROM events)"""


def texts(spark, folder):
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("value").cast("string").alias("amount"),
        F.when(kind == "error", F.lit("n/a"))
        .otherwise(F.col("user_id").cast("string"))
        .alias("code"),
        F.when(kind == "view", F.lit("unknown"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
        .alias("seen"),
        F.when(kind == "click", F.col("user_id").cast("string")).alias("rare"),
        "props",
    )


@query(
    TEXTS
    + """, c AS (
  SELECT 'amount' AS "column", amount AS x FROM t UNION ALL SELECT 'code', code FROM t
  UNION ALL SELECT 'seen', seen FROM t UNION ALL SELECT 'rare', rare FROM t
  UNION ALL SELECT 'props', props FROM t)
SELECT "column", round(avg(CAST(TRY_CAST(x AS DOUBLE) IS NOT NULL AS INT)), 6) AS numeric_share,
  round(avg(CAST(x LIKE '2024-%' AS INT)), 6) AS time_share,
  CAST(sum(CAST(x IS NOT NULL AND TRY_CAST(x AS DOUBLE) IS NULL AS INT)) AS BIGINT) AS non_numeric
FROM (SELECT "column", x FROM c) GROUP BY "column" """.replace(
        "avg(CAST(x LIKE '2024-%' AS INT))", "avg(CAST(coalesce(x LIKE '2024-%', false) AS INT))"
    )
)
def parse_shares(spark, folder):
    got = standardise.parse_shares(texts(spark, folder))
    return got.select(
        "column",
        F.round("numeric_share", 6).alias("numeric_share"),
        F.round("time_share", 6).alias("time_share"),
        "non_numeric",
    )


@query(
    TEXTS
    + """ SELECT CAST(amount AS DOUBLE) AS amount, TRY_CAST(code AS BIGINT) AS code,
  CAST(CASE WHEN seen LIKE '2024-%' THEN epoch(CAST(seen AS TIMESTAMP)) END AS BIGINT) AS seen_s,
  CAST(rare AS BIGINT) AS rare, props FROM t"""
)
def infer_types(spark, folder):
    """Text becomes numbers (also the sparse all-number column) and times; the rest stays."""
    t = standardise.infer_types(texts(spark, folder))
    return t.select("amount", "code", F.unix_timestamp("seen").alias("seen_s"), "rare", "props")


@query(TEXTS + " SELECT amount, code, seen, props FROM t")
def drop_sparse_columns(spark, folder):
    return standardise.drop_sparse_columns(texts(spark, folder), 0.75)[0]


@query("SELECT event_id, user_id, event_type, value FROM events")
def drop_named_columns(spark, folder):
    return standardise.drop_columns(table(spark, folder, "events"), ["TS", " props", "no such"])


@query(
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s,
  CASE WHEN event_type = 'error' THEN NULL ELSE epoch_us(date_trunc('day', ts)) // 1000000 END AS day_s
FROM events"""
)
def parse_epoch(spark, folder):
    """One axis as epoch milliseconds in text, one as seconds, one as dates with bad cells."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, folder, "events").select(
        "event_id",
        F.floor(micros / 1000).cast("string").alias("a"),
        F.floor(micros / 1000000).cast("bigint").alias("b"),
        F.when(F.col("event_type") == "error", F.lit("?"))
        .otherwise(F.date_format("ts", "MM/dd/yyyy"))
        .alias("c"),
    )
    a, b, c = (standardise.parse_time(e, x) for x in "abc")
    return e.select(
        "event_id",
        F.unix_millis(a).alias("ms"),
        F.unix_seconds(b).alias("s"),
        F.unix_seconds(c).alias("day_s"),
    )


@query(
    """SELECT event_id, round(date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts)
  / 1e6 / 86400 / 30.44, 2) AS months FROM events"""
)
def months_since_baseline(spark, folder):
    e = standardise.months_since_baseline(table(spark, folder, "events"), "user_id", "ts", "months")
    return e.select("event_id", "months")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS pid, CAST(event_id AS VARCHAR) AS session_id,
  '' AS site, value AS score FROM events"""
)
def role_projection(spark, folder):
    none = F.lit("")
    return standardise.project_roles(
        table(spark, folder, "events").select(
            F.col("user_id").cast("string").alias("healthcode"),
            F.col("event_id").cast("string").alias("recordid"),
            "value",
        ),
        {"pid": "healthcode", "session_id": "recordid", "score": "value"},
        {"pid": none, "session_id": none, "site": none, "score": F.lit(None).cast("double")},
    )


PRIORITY_MAP = "high, urgent -> RUSH\nlow -> SLOW\nlow, not -> OTHER_TEXT"
KEYWORD_RULE = {
    "type": "keyword_map",
    "source_col": "o_orderpriority",
    "output_col": "pace",
    "mappings": rules.parse_keyword_mappings(PRIORITY_MAP),
    "default": "NORMAL",
}


@query(
    """SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%high%'
    OR lower(o_orderpriority) LIKE '%urgent%' THEN 'RUSH'
  WHEN lower(o_orderpriority) LIKE '%low%' THEN 'SLOW'
  WHEN lower(o_orderpriority) LIKE '%not%' THEN 'OTHER_TEXT' ELSE 'NORMAL' END AS pace FROM orders"""
)
def rule_keyword(spark, folder):
    out, _ = rules.apply_rules(table(spark, folder, "orders"), [KEYWORD_RULE], strict=True)
    return out.select("o_orderkey", "pace")


@query(
    """SELECT p_partkey, CASE WHEN p_size > 1 AND p_size <= 15 THEN 'small'
  WHEN p_size > 15 AND p_size <= 35 THEN 'medium'
  WHEN p_size > 35 AND p_size <= 49 THEN 'large' END AS size_band FROM part"""
)
def rule_bin(spark, folder):
    rule = {
        "type": "numeric_bin",
        "source_col": "p_size",
        "output_col": "size_band",
        "bins": [1, 15, 35, 49],
        "labels": ["small", "medium", "large"],
    }
    out, _ = rules.apply_rules(table(spark, folder, "part"), [rule], strict=True)
    return out.select("p_partkey", "size_band")


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open'
  ELSE 'partly' END AS state FROM orders"""
)
def rule_proxy(spark, folder):
    rule = {
        "type": "proxy_label",
        "source_col": "o_orderstatus",
        "output_col": "state",
        "mapping": {"F": "done", "O": "open", "__default__": "partly"},
    }
    out, _ = rules.apply_rules(table(spark, folder, "orders"), [rule], strict=True)
    return out.select("o_orderkey", "state")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey,
  l_extendedprice * (1 - l_discount) / nullif(l_quantity - 1, 0) AS unit_price,
  pow(l_quantity, 2) + floor(l_extendedprice / 7) AS odd_mix FROM lineitem"""
)
def rule_formula(spark, folder):
    both = [
        {
            "type": "formula",
            "output_col": "unit_price",
            "expression": "l_extendedprice * (1 - l_discount) / (l_quantity - 1)",
        },
        {
            "type": "formula",
            "output_col": "odd_mix",
            "expression": "l_quantity ** 2 + l_extendedprice // 7",
        },
    ]
    out, _ = rules.apply_rules(table(spark, folder, "lineitem"), both, strict=True)
    return out.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "unit_price",
        "odd_mix",
    )


@query(
    """WITH a AS (SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%high%'
    OR lower(o_orderpriority) LIKE '%urgent%' THEN 'RUSH'
  WHEN lower(o_orderpriority) LIKE '%low%' THEN 'SLOW'
  WHEN lower(o_orderpriority) LIKE '%not%' THEN 'OTHER_TEXT' ELSE 'NORMAL' END AS pace,
  round(date_diff('microsecond', min(o_orderdate) OVER (PARTITION BY o_custkey), o_orderdate)
    / 1e6 / 86400 / 30.44, 2) AS months, o_totalprice FROM orders)
SELECT o_orderkey, pace, months, o_totalprice / nullif(months, 0) AS price_per_month,
  CASE WHEN months > 0 AND months <= 12 THEN 'year 1' WHEN months > 12 AND months <= 120
    THEN 'later' END AS phase,
  CASE WHEN pace = 'RUSH' THEN 'hot' ELSE 'cold' END AS heat FROM a"""
)
def rule_chain(spark, folder):
    chain = [
        KEYWORD_RULE,
        {
            "type": "months_since_baseline",
            "time_col": "o_orderdate",
            "entity_id_col": "o_custkey",
            "output_col": "months",
        },
        {"type": "formula", "output_col": "price_per_month", "expression": "o_totalprice / months"},
        {
            "type": "numeric_bin",
            "source_col": "months",
            "output_col": "phase",
            "bins": [0, 12, 120],
            "labels": ["year 1", "later"],
        },
        {
            "type": "proxy_label",
            "source_col": "pace",
            "output_col": "heat",
            "mapping": {"RUSH": "hot", "__default__": "cold"},
        },
    ]
    out, _ = rules.apply_rules(table(spark, folder, "orders"), chain, strict=True)
    return out.select(
        "o_orderkey",
        "pace",
        "months",
        "price_per_month",
        "phase",
        "heat",
    )


# Each order line carries a list of event times made of its own numbers: seven stamps, five, or a
# list with a bad token.
STAMPS = """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
  [CAST(l_orderkey AS DOUBLE), l_partkey, l_suppkey, l_quantity, l_linenumber] AS five,
  [CAST(l_orderkey AS DOUBLE), l_partkey, l_suppkey, l_quantity, l_linenumber, l_discount,
   l_extendedprice] AS seven FROM lineitem),
g AS (SELECT *, list_sort(CASE l_returnflag WHEN 'A' THEN seven WHEN 'N' THEN five END) AS st FROM s),
d AS (SELECT *, [st[i + 1] - st[i] for i in range(1, len(st))] AS gap FROM g)"""


def stamp_lists(spark, folder):
    five = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber"]
    text = F.concat_ws(", ", *five)
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").withColumn(
        "stamps",
        F.when(flag == "A", F.concat(F.lit("["), text, F.lit(", "), F.concat_ws(",", "l_discount", "l_extendedprice"), F.lit("]")))
        .when(flag == "N", F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(F.concat(F.lit("["), text, F.lit(", broken]"))),
    )


@query(
    STAMPS
    + """ SELECT l_orderkey, l_linenumber, l_partkey,
  round(list_stddev_pop(gap), 6) AS tap_variability,
  CASE WHEN len(st) >= 6 THEN round(1 / nullif(list_avg(gap[len(gap) // 2 + 1:]), 0)
    - 1 / nullif(list_avg(gap[:len(gap) // 2]), 0), 6) END AS tap_fatigue_slope FROM d"""
)
def tap_lists(spark, folder):
    out = sessions.tap_metrics(stamp_lists(spark, folder), stamps="stamps")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "tap_variability", "tap_fatigue_slope"
    )


@query(
    """SELECT event_id, round(user_id / nullif(CASE WHEN event_type = 'error' THEN 0 ELSE value END, 0), 4)
  AS tap_rate FROM events"""
)
def tap_rate(spark, folder):
    e = table(spark, folder, "events").withColumn(
        "dur", F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value"))
    )
    return sessions.tap_metrics(e, "user_id", "dur").select("event_id", "tap_rate")


# Raw sessions: views carry a list, clicks a count in text, purchases a count out of range, the
# other kinds a file handle or nothing.
RAW = """WITH raw AS (SELECT event_id, event_type, value,
  CASE event_type WHEN 'view' THEN 'Just after Parkinson medication (at your best)'
    WHEN 'click' THEN 'Immediately before Parkinson medication'
    WHEN 'purchase' THEN 'I don''t take Parkinson medications'
    WHEN 'signup' THEN 'Another time' END AS med,
  CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN CASE WHEN user_id <= 300 THEN user_id END
    END AS tap_cnt, user_id FROM events)"""


def raw_sessions(spark, folder):
    kind = F.col("event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, folder, "events").select(
        F.when(kind != "signup", F.col("user_id").cast("string")).alias("healthCode"),
        F.col("event_id").cast("string").alias("recordId"),
        F.lit("0").alias("tapping_results.json.startDate"),
        F.when(micros.isNotNull(), F.round(F.col("value") * 1000).cast("bigint").cast("string")).alias(
            "tapping_results.json.endDate"
        ),
        F.when(kind == "view", F.lit("Just after Parkinson medication (at your best)"))
        .when(kind == "click", F.lit("Immediately before Parkinson medication"))
        .when(kind == "purchase", F.lit("I don't take Parkinson medications"))
        .when(kind == "signup", F.lit("Another time"))
        .alias("medTimepoint"),
        F.when(kind == "view", F.concat(F.lit("["), F.col("value"), F.lit(", 2, 3]")))
        .when(kind == "click", F.col("user_id").cast("string"))
        .when(kind == "purchase", F.lit("90210"))
        .when(kind == "signup", F.lit("abc"))
        .alias("tapping_results.json.TappingSamples"),
    )


@query(
    RAW
    + """ SELECT CAST(event_id AS VARCHAR) AS session_id,
  CAST(CASE WHEN med LIKE '%don''t take%' THEN 0 ELSE 1 END AS BIGINT) AS dx_proxy,
  CASE WHEN event_type = 'view' THEN 'AFTER' WHEN event_type = 'click' THEN 'BEFORE'
    WHEN event_type = 'purchase' THEN NULL ELSE 'OTHER' END AS pd_state,
  CAST(CASE WHEN event_type = 'view' THEN 2 WHEN event_type = 'click' THEN 1
    WHEN event_type = 'purchase' THEN NULL ELSE 3 END AS BIGINT) AS pd_code,
  round(value, 3) AS duration_sec, CAST(tap_cnt AS BIGINT) AS tap_cnt,
  round(tap_cnt / nullif(value, 0), 4) AS tap_hz,
  CAST(tap_cnt IS NULL AS BIGINT) AS tap_samples_is_filehandle,
  coalesce(nullif(concat_ws(',', CASE WHEN event_type = 'signup' THEN 'missing_pid' END,
    CASE WHEN value <= 0 THEN 'nonpositive_duration' END,
    CASE WHEN value < 5 OR value > 60 THEN 'duration_out_of_range(5.0-60.0)' END), ''), 'OK') AS qc_reason
FROM raw"""
)
def clean_sessions(spark, folder):
    full = sessions.clean_sessions(raw_sessions(spark, folder)).full
    return full.select(
        "session_id",
        "dx_proxy",
        "pd_state",
        "pd_code",
        F.round("duration_sec", 3).alias("duration_sec"),
        "tap_cnt",
        F.round("tap_hz", 4).alias("tap_hz"),
        "tap_samples_is_filehandle",
        "qc_reason",
    )


@query(
    RAW
    + """ SELECT event_id, CASE event_type WHEN 'view' THEN 'AFTER' WHEN 'click' THEN 'BEFORE'
    WHEN 'purchase' THEN 'NO_MEDS' WHEN 'signup' THEN 'OTHER' END AS med_state,
  CAST(CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 WHEN 'purchase' THEN 0
    WHEN 'signup' THEN 3 END AS BIGINT) AS med_code,
  CAST(CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN NULL ELSE 1 END AS BIGINT) AS dx_proxy
FROM raw"""
)
def medication_states(spark, folder):
    """Missing text stays missing under the strict policy."""
    raw = raw_sessions(spark, folder).withColumn("event_id", F.col("recordId").cast("bigint"))
    out = sessions.medication_columns(raw, "medTimepoint", null_policy="null")
    return out.select("event_id", "med_state", "med_code", "dx_proxy")


@query(
    """SELECT event_id, CAST(CASE WHEN event_type = 'view' THEN 3 WHEN event_type = 'click' THEN NULL
  WHEN event_type = 'error' THEN 2 END AS BIGINT) AS n_items FROM events"""
)
def list_lengths(spark, folder):
    """Three items, a one-item list, two objects, and text that is no list."""
    from studyspark.functions.signal import list_length

    kind = F.col("event_type")
    e = visits(spark, folder).withColumn(
        "cell",
        F.when(kind == "view", F.concat(F.lit(" ["), F.col("user_id"), F.lit(", 1.5, 2]")))
        .when(kind == "click", F.lit("[7]"))
        .when(kind == "error", F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]")))
        .otherwise(F.lit("17")),
    )
    return e.select("event_id", list_length(F.col("cell")).alias("n_items"))


@query(
    """SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%high%'
    OR lower(o_orderpriority) LIKE '%urgent%' THEN 'RUSH'
  WHEN lower(o_orderpriority) LIKE '%low%' THEN 'SLOW'
  WHEN lower(o_orderpriority) LIKE '%not%' THEN 'OTHER_TEXT' ELSE 'NORMAL' END AS pace,
  o_totalprice * 2 AS twice, CAST(1 AS BIGINT) AS issues FROM orders"""
)
def rule_config(spark, folder):
    """Rules of a saved config, loaded again, checked and applied; one names a missing column."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    twice = {"type": "formula", "output_col": "twice", "expression": "o_totalprice * 2"}
    lost = {**KEYWORD_RULE, "source_col": "nowhere", "output_col": "lost"}
    rules.save_config(spark, {"rules": [KEYWORD_RULE, twice, lost]}, path)
    loaded = rules.load_config(spark, path)["rules"]
    orders = table(spark, folder, "orders")
    out, _ = rules.apply_rules(orders, loaded)
    issues = rules.validate_rules(loaded, orders.columns)
    return out.select("o_orderkey", "pace", "twice", F.lit(len(issues)).cast("bigint").alias("issues"))


@query(
    """SELECT CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS l_partkey,
  CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus
FROM lineitem"""
)
def first_numeric_columns(spark, folder):
    """Sums of the first three numeric columns, and the largest value of each text column."""
    line = table(spark, folder, "lineitem")
    return line.agg(
        *[F.sum(c).alias(c) for c in numeric_columns(line, 3)], *[F.max(c).alias(c) for c in text_columns(line)]
    )
