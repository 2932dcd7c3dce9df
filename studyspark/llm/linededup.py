"""Delete repeated runs of lines, keeping their first place, in DataFrame functions only.

A suffix array over the line sequences is built by prefix doubling: the rank of the run of 2^(k+1)
lines at a place comes from the ranks of its two halves. Ranks are hashes, so each document doubles
its own and equal runs get equal ranks without a global sort per round; all that deletion needs of
the array are its intervals of equal prefixes. A run of any length is named by the two ranks, of
the largest power of two inside it, that cover it from both ends. Places with one name form a
longest-common-prefix interval; all but the first are later copies. Ranks are built twice, by hashes
of two seeds, so 128 bits say that two runs are equal.

A maximal repeated run of `min_words` words or more is exactly the union of its smallest windows of
at least `min_words` words that begin, or end, at each of its lines. So each line names two windows
only, and every line of every maximal run is found by one shuffle of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.llm.base import packed, query, table, text_key
from studyspark.operators.lineage import cut

MIN_WORDS = 30
SEAL = 0x5EA1  # seed of the second hashes
HOT = 1_000  # a name with more than 1/HOT of all places is hot, so there are fewer than HOT of them


def _doubled(ranks: Column, seals: Column, words: Column, step: int) -> tuple[Column, Column, Column]:
    """Ranks, seals and word sums of runs twice as long; `step` is the length of the given runs."""
    last = F.size(ranks) - step
    places = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return (
        F.transform(places, lambda i: F.xxhash64(F.get(ranks, i), F.get(ranks, i + step))),
        F.transform(places, lambda i: F.xxhash64(F.lit(SEAL), F.get(seals, i), F.get(seals, i + step))),
        F.transform(places, lambda i: F.get(words, i) + F.get(words, i + step)),
    )


def line_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, th, start, end, name, seal) of the windows of rows (id, th, ranks, seals, words).

    `ranks`, `seals` and `words` are arrays over the lines of a document: two hashes and the number
    of words.
    """
    longest = rows.agg(F.max(F.size("ranks"))).first()[0] or 0
    levels = max(int(longest) - 1, 0).bit_length()  # 2^levels >= longest
    df = rows.select("id", "th", F.col("ranks").alias("r0"), F.col("seals").alias("q0"), F.col("words").alias("s0"))
    for k in range(levels):
        ranks, seals, words = _doubled(F.col(f"r{k}"), F.col(f"q{k}"), F.col(f"s{k}"), 1 << k)
        df = df.withColumns({f"r{k + 1}": ranks, f"q{k + 1}": seals, f"s{k + 1}": words})
    df = df.select(
        "id",
        "th",
        F.size("r0").alias("n"),
        F.array(*[f"r{k}" for k in range(levels + 1)]).alias("r"),
        F.array(*[f"q{k}" for k in range(levels + 1)]).alias("q"),
        F.array(*[f"s{k}" for k in range(levels + 1)]).alias("s"),
    )
    down = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(1 << k).alias("size")) for k in range(levels, -1, -1)])
    none = F.lit(0).cast("bigint")

    def forward(i):
        """First line from `i` on by which the window is full; n if it never is."""
        walked = F.aggregate(
            down,
            F.struct(i.alias("at"), none.alias("sum")),
            lambda st, step: F.when(
                st["sum"] + F.coalesce(F.get(F.get("s", step["k"]), st["at"]), F.lit(1 << 60)) < min_words,
                F.struct(
                    (st["at"] + step["size"]).alias("at"),
                    (st["sum"] + F.get(F.get("s", step["k"]), st["at"])).alias("sum"),
                ),
            ).otherwise(st),
            lambda st: st["at"],
        )
        return F.struct(i.alias("start"), walked.alias("end"))

    def backward(j):
        """Last line up to `j` from which the window is full; -1 if it never is."""
        walked = F.aggregate(
            down,
            F.struct(j.alias("at"), none.alias("sum")),
            lambda st, step: F.when(
                (st["at"] - step["size"] + 1 >= 0)
                & (
                    st["sum"]
                    + F.coalesce(
                        F.get(F.get("s", step["k"]), F.greatest(st["at"] - step["size"] + 1, F.lit(0))),
                        F.lit(1 << 60),
                    )
                    < min_words
                ),
                F.struct(
                    (st["at"] - step["size"]).alias("at"),
                    (st["sum"] + F.get(F.get("s", step["k"]), F.greatest(st["at"] - step["size"] + 1, F.lit(0)))).alias("sum"),
                ),
            ).otherwise(st),
            lambda st: st["at"],
        )
        return F.struct(walked.alias("start"), j.alias("end"))

    lines = F.sequence(F.lit(0), F.col("n") - 1)
    spans = F.array_distinct(F.concat(F.transform(lines, forward), F.transform(lines, backward)))
    whole = df.where("n > 0").select(
        "id", "th", "n", "r", "q", F.explode(spans).alias("w")
    ).where((F.col("w.start") >= 0) & (F.col("w.end") < F.col("n")))
    placed = whole.select(
        "id",
        "th",
        "r",
        "q",
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        (F.col("w.end") - F.col("w.start") + 1).alias("length"),
    # the number of binary digits, less one: exact where a logarithm might not be
    ).withColumn("level", F.length(F.bin("length")) - 1)
    tail = F.col("end") + 1 - F.expr("shiftleft(1, level)")
    ranks, seals = F.get("r", F.col("level")), F.get("q", F.col("level"))
    return placed.select(
        "id",
        "th",
        "start",
        "end",
        F.xxhash64(F.get(ranks, F.col("start")), F.get(ranks, tail), F.col("length")).alias("name"),
        F.xxhash64(F.lit(SEAL), F.get(seals, F.col("start")), F.get(seals, tail)).alias("seal"),
    )


def repeated_lines(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, th, lines): the line numbers of each document that lie in a later copy of a run."""
    place = F.struct(F.col("id").isNull().alias("no"), "id", "th", "start")
    runs = cut(line_runs(rows, min_words))
    both = ["name", "seal"]
    intervals = cut(
        runs.groupBy(*both)
        .agg(F.count(F.lit(1)).alias("places"), F.min(place).alias("first"))
        .where(F.col("places") > 1)
    )
    # a run that stands in very many documents is sent to its places, not its places to one task
    is_hot = F.col("places") * HOT > runs.count()
    hot, rest = intervals.where(is_hot), intervals.where(~is_hot)
    named = runs.join(F.broadcast(hot.select(*both)), both, "left_anti").join(rest, both)
    later = runs.join(F.broadcast(hot), both).unionByName(named).where(place != F.col("first"))
    return (
        later.select("id", "th", F.explode(F.sequence("start", "end")).alias("line"))
        .groupBy("id", "th")
        .agg(F.collect_set("line").alias("lines"))
    )


def drop_repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row, text, n_lines, n_deleted) of every row of `docs`; `row` holds all its columns.

    Lines are parted by \\n and equal if their characters are. Of every run of lines with at least
    `min_words` words that stands more than once, in one document or several, the first place stays,
    by smallest id (null last), then by line. Shorter runs stay, whatever their number. Null text
    stays null and has no lines; a text whose lines all go becomes empty. Rows with equal id and
    text are one document here: what stays, stays in each of them.
    """
    text = F.col(text_col).cast("string")
    lines = F.split(text, "\n")
    # a few bytes per line, written once for the passes below; texts are read again, not written
    rows = cut(
        docs.where(text.isNotNull()).select(
            F.col(id_col).alias("id"),
            F.xxhash64(text).alias("th"),
            F.transform(lines, lambda x: F.xxhash64(x)).alias("ranks"),
            F.transform(lines, lambda x: F.xxhash64(F.lit(SEAL), x)).alias("seals"),
            F.transform(
                lines, lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
            ).alias("words"),
        )
    )
    found = repeated_lines(rows, min_words).select(F.struct("id", "th").alias("key"), "lines")
    joined = packed(docs, key=text_key(F.col(id_col), text)).join(found, "key", "left")
    text = F.col("row").getField(text_col).cast("string")
    n = F.size(F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lines"))
    split = F.split(text, "\n")
    kept = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    return joined.select(
        "row",
        F.when(F.col("lines").isNull(), text).otherwise(kept).alias("text"),
        F.coalesce(F.when(text.isNotNull(), n), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_deleted"),
    )


_ORACLE = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, i, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n FROM l),
p AS (SELECT a.doc_id, a.i, a.n, b.doc_id AS from_doc, a.i - b.i AS diag
      FROM w a JOIN w b ON a.s = b.s AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, from_doc, diag ORDER BY i) AS island FROM p),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, from_doc, diag, island) AS words FROM g),
x AS (SELECT DISTINCT doc_id, i FROM r WHERE words >= {MIN_WORDS}),
k AS (SELECT w.doc_id, w.i, w.s, x.i IS NOT NULL AS gone FROM w LEFT JOIN x USING (doc_id, i)),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_deleted,
             coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
      FROM k GROUP BY doc_id)
SELECT d.doc_id, a.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN a USING (doc_id)"""


@query(_ORACLE)
def op8_line_dedup(spark, folder):
    found = drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id"), "text", "n_lines", "n_deleted")
