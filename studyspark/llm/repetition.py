"""Quality rules: how much of a text stands in repeated n-grams and repeated lines.

Every document is measured whole, in one narrow pass without a shuffle. Rolling hashes of 64 bits
stand for n-grams and lines; coverage counts characters, so one long repeated passage weighs more
than a repeated pair of short words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyspark.llm.base import query, table
from studyspark.llm.wordbytes import Spans, chunks, covered, per_document, repeated, windows

WINDOW = 5
# Largest share, in per cent of the word characters, that may lie inside repeated n-grams.
COVERAGE_LIMITS = {5: 20, 7: 18, 10: 15}
LINE_LIMIT = 30
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "dup_line_chars",
    *(f"dup_{n}gram_chars" for n in COVERAGE_LIMITS),
)


def _measure(chunk) -> dict[str, np.ndarray]:
    start, end, own = chunk.words()
    n = chunk.n
    points = chunk.points()
    length = points[end] - points[start]
    spans = Spans(chunk.data)
    hashes = spans.hash(start, end)
    out = {
        "n_words": per_document(own, n),
        "word_chars": per_document(own, n, length),
    }
    marks = np.flatnonzero(_SYMBOL[chunk.data])
    out["n_symbols"] = per_document(chunk.owner(marks), n)
    for size in sorted({WINDOW, *COVERAGE_LIMITS}):
        first, gram = windows(hashes, own, size)
        hit = covered(first[repeated(gram, own[first])], size, len(start))
        if size == WINDOW:
            out["n_repeat_words"] = per_document(own[hit], n)
        if size in COVERAGE_LIMITS:
            out[f"dup_{size}gram_chars"] = per_document(own[hit], n, length[hit])
    # lines that hold a word
    at, stop, line_own = chunk.lines()
    before = np.searchsorted(start, at), np.searchsorted(start, stop)
    full = before[1] > before[0]
    at, stop, line_own = at[full], stop[full], line_own[full]
    held = np.concatenate([[0], np.cumsum(length)])
    chars = held[before[1][full]] - held[before[0][full]]
    key = spans.hash(at, stop)
    order = np.lexsort((np.arange(len(key)), key, line_own))
    later = np.zeros(len(key), bool)
    later[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (
        line_own[order[1:]] == line_own[order[:-1]]
    )
    out["n_dup_lines"] = per_document(line_own[later], n)
    out["dup_line_chars"] = per_document(line_own[later], n, chars[later])
    return out


def measure_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id and the counts named in `MEASURES`.

    Null text counts as empty and has zeros everywhere. Ids may be null or repeat; every input row
    gives one output row. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                got = _measure(chunk)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(chunk.first, chunk.n), *(pa.array(got[m]) for m in MEASURES)],
                    ["id", *MEASURES],
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def judge_repetition(measured: DataFrame) -> DataFrame:
    """Adds `base_failed` and `kept`.

    A text fails the base rule with fewer than ten words, or with over a fifth of its words in
    repeated five-word windows. The coverage rule rejects it if the characters inside repeated
    n-grams of any length in `COVERAGE_LIMITS`, or inside lines that repeat an earlier line, exceed
    their limit in per cent of all word characters.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    within = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, most in COVERAGE_LIMITS.items():
        within = within & (100 * F.col(f"dup_{n}gram_chars") <= most * F.col("word_chars"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & within
    )


def _oracle() -> str:
    """The same result in SQL: windows by position, coverage by a running maximum."""
    grams = sorted({WINDOW, *COVERAGE_LIMITS})
    steps, sums = [], []
    for n in grams:
        key = " || ' ' || ".join(
            "w" if k == 0 else f"lead(w, {k}) OVER p" for k in range(n)
        )
        steps.append(f"{key} AS g{n}")
        sums.append(n)
    counted = ", ".join(
        f"CASE WHEN g{n} IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY rid, g{n}) > 1 THEN 1"
        f" ELSE 0 END AS d{n}"
        for n in sums
    )
    spread = ", ".join(
        f"max(d{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND"
        f" CURRENT ROW) AS c{n}"
        for n in sums
    )
    chars = ", ".join(
        f"CAST(coalesce(sum(length(w) * c{n}), 0) AS BIGINT) AS dup_{n}gram_chars"
        for n in COVERAGE_LIMITS
    )
    names = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in COVERAGE_LIMITS)
    limits = " AND ".join(
        f"100 * dup_{n}gram_chars <= {most} * word_chars" for n, most in COVERAGE_LIMITS.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT rid, i, w, {", ".join(steps)} FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
m AS (SELECT rid, i, w, {counted} FROM g),
c AS (SELECT rid, w, {spread} FROM m),
a AS (SELECT rid, count(*) AS n_words, CAST(sum(length(w)) AS BIGINT) AS word_chars,
             CAST(sum(c{WINDOW}) AS BIGINT) AS n_repeat_words, {chars} FROM c GROUP BY rid),
ll AS (SELECT rid, s, i,
              length(regexp_replace(s, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS s,
                    generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
k AS (SELECT rid, chars, row_number() OVER (PARTITION BY rid, s ORDER BY i) AS nth
      FROM ll WHERE chars > 0),
b AS (SELECT rid, count(*) AS n_dup_lines, CAST(sum(chars) AS BIGINT) AS dup_line_chars
      FROM k WHERE nth > 1 GROUP BY rid),
r AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT)
               AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(dup_line_chars, 0) AS dup_line_chars, {names}
      FROM d LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT *, NOT base_failed AND 100 * dup_line_chars <= {LINE_LIMIT} * word_chars AND {limits}
       AS kept
FROM f"""


@query(_oracle())
def op10_repetition_rules(spark, folder):
    return judge_repetition(measure_repetition(table(spark, folder, "documents")))
