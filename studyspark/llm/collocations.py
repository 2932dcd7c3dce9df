"""Phrase collocation mining by top-order marginalisation.

Each word opens one window of four lead columns, padded with '' where its piece ends. Only these
longest windows are counted; Spark's ROLLUP over the columns sums them into the counts of every
shorter phrase, so there is no explosion per n-gram length into the result's counts.

Most windows of prose stand once, and shuffling them would cost many times the input. A phrase can't
be frequent unless both its parts without one end word are, so a window stops where that fails: for
lengths one to three, hashes are counted in turn, only at places that the length before let through,
and the hashes that stand often enough become a filter of bounded size for the tasks (a hash let
through in error only costs shuffle). Windows hold words, so counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyspark.llm.base import query, table
from studyspark.llm.wordbytes import Chunk, Spans, chunks, mix
from studyspark.operators.keyed import attach
from studyspark.operators.lineage import cut

ORDER = 4  # words of the longest phrase
LEAST = 30  # occurrences of a candidate
COVER = 80  # per cent of a phrase's places that one longer candidate must hold to replace it
SCALE = 2_000_000
TOP = 2000
CHUNK = 2 << 20  # bytes of text whose windows are folded before Spark sees them
# A filter has about sixteen bits for each frequent hash, within these bounds.
FEWEST_BITS, MOST_BITS = 20, 28
BLOCK_BITS = 32768  # of Spark's bitmap functions
SALTS = 64

_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?"]] = True
_SPLIT[0x0A:0x0E] = True
_APART = _SPLIT.copy()
_APART[[0x20, 0x09]] = True


def _encoded(chunk: Chunk) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(word numbers, words, documents, pieces) of a chunk; words are compared whole."""
    start, end, own = chunk.runs(_APART)
    length = end - start
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], length)
    data = chunk.lowered()[at]
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data))
    listed = words.dictionary_encode()
    ended = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum(_SPLIT[chunk.data], out=ended[1:])
    piece = ended[start] if len(start) else np.zeros(0, np.int64)
    return np.asarray(listed.indices).astype(np.int64), listed.dictionary, own, piece


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash for each word of a dictionary, the same in every task."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
    return Spans(data).hash(offsets[:-1], offsets[1:])


def _lang_hash(name: str) -> np.uint64:
    return _word_hashes(pa.array([name], pa.large_string()))[0]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, tuple]]:
    """Texts of a batch by language, in chunks of bounded size, as word numbers."""
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        texts = batch.column(1).filter(pc.equal(langs, lang))
        for chunk in chunks(texts, CHUNK):
            yield lang, _encoded(chunk)


def _known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(8 * len(bits) - 1)
    found = bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)
    return (found & 1).astype(bool)


def _hopeful(lang: str, part: tuple, filters: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hash, hope) of the phrases of one word, two words, .. at each place of a part.

    Hope is lost where a piece ends, and where a filter doesn't know the phrase or one inside it. The
    last pair is for one length more than there are filters.
    """
    words, listed, own, piece = part
    each = _word_hashes(listed)[words]
    joined = np.zeros(len(words), bool)
    joined[:-1] = (own[1:] == own[:-1]) & (piece[1:] == piece[:-1])
    h, hope = mix(each + _lang_hash(lang)), np.ones(len(words), bool)
    out = []
    for k, bits in enumerate([*filters, None], 1):
        if k > 1:
            longer = np.zeros(len(words), bool)
            longer[:-1] = hope[:-1] & hope[1:] & joined[:-1]
            grown = h.copy()
            grown[: len(words) - k + 1] = mix(h[: len(words) - k + 1] * np.uint64(3) + mix(each[k - 1 :]))
            h, hope = grown, longer
        if bits is not None:
            hope = hope & _known(np.frombuffer(bits, np.uint8), h)
        out.append((h, hope))
    return out


def _folded(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of one row of each kind, number of rows) of equal rows; cells are below `size`."""
    key = columns[0]
    for c in columns[1:]:
        # numbers below len(key), so products stay in 64 bits
        key = np.unique(key, return_inverse=True)[1] * size + c
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return first, count


def hash_counts(rows: DataFrame, filters: list[bytes]) -> DataFrame:
    """(h, c) per chunk of text: hashes of the phrases of rows (lang, text) that are one word longer
    than the last filter's and may be frequent, and their counts."""
    sent = rows.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for lang, part in _parts(batch):
                h, hope = _hopeful(lang, part, sent.value)[-1]
                h, c = np.unique(h[hope], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return rows.mapInArrow(run, "h bigint, c bigint")


def hash_filter(counts: DataFrame, least: int) -> bytes:
    """Bits that are set for the hashes of (h, c) which stand `least` times or more.

    As many bits as the hashes need, up to 2^MOST_BITS (32 MB); beyond, the filter lets more through.
    """
    often = cut(counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least).select("h"))
    bits = min(max((16 * often.count()).bit_length(), FEWEST_BITS), MOST_BITS)
    low = F.col("h").bitwiseAND((1 << bits) - 1)
    out = bytearray(1 << (bits - 3))
    blocks = often.groupBy(F.shiftright(low, BLOCK_BITS.bit_length() - 1).alias("block")).agg(
        F.expr(f"bitmap_construct_agg(h & {BLOCK_BITS - 1})").alias("bits")
    )
    for r in blocks.collect():
        at = r["block"] * (BLOCK_BITS // 8)
        out[at : at + BLOCK_BITS // 8] = r["bits"]
    return bytes(out)


def window_counts(rows: DataFrame, filters: list[bytes]) -> DataFrame:
    """(lang, w0.., c): the windows that each word of rows (lang, text) opens, padded with '', of one
    word more than there are filters.

    Counted per chunk of text. A window ends where no longer phrase may be frequent; that of a word
    which is too rare itself is all padding.
    """
    sent = rows.sparkSession.sparkContext.broadcast(filters)
    order = len(filters) + 1

    def run(batches):
        for batch in batches:
            for lang, part in _parts(batch):
                words, listed = part[:2]
                pad, columns = len(listed), []
                for k, (_, hope) in enumerate(_hopeful(lang, part, sent.value)):
                    column = np.full(len(words), pad, np.int64)
                    at = np.flatnonzero(hope)
                    column[at] = words[at + k]
                    columns.append(column)
                first, count = _folded(columns, pad + 1)
                names = pa.concat_arrays([listed, pa.array([""], pa.large_string())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(first), np.int64))),
                        *[names.take(pa.array(c[first])) for c in columns],
                        pa.array(count.astype(np.int64)),
                    ],
                    ["lang", *[f"w{k}" for k in range(order)], "c"],
                )

    fields = ", ".join(f"w{k} string" for k in range(order))
    return rows.mapInArrow(run, f"lang string, {fields}, c bigint")


def phrase_counts(
    docs: DataFrame, least: int = LEAST, order: int = ORDER, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, words, f): every phrase of up to `order` words that stands `least` times or more.

    The row of a language without words has the number of all its word occurrences.
    """
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    filters: list[bytes] = []
    for _ in range(order - 1):
        filters.append(hash_filter(hash_counts(rows, filters), least))
    leads = [f"w{k}" for k in range(order)]
    # folded over tasks first, so that the roll-up reads each window once
    top = window_counts(rows, filters).groupBy("lang", *leads).agg(F.sum("c").alias("c"))
    sums = top.rollup("lang", *leads).agg(F.sum("c").alias("f"))
    words = F.array_compact(F.array(*leads))
    return (
        sums.where(F.col("lang").isNotNull() & ((F.col("f") >= least) | F.col("w0").isNull()))
        .select("lang", words.alias("words"), "f")
        .where(~F.array_contains("words", ""))
    )


def mine_collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP,
    cover: int = COVER,
    order: int = ORDER,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language.

    A phrase's score is floor(2000000 a / (l + r)) of its worst cut, a being its own count and l and r
    those of its parts (of equal cuts the first). Phrases inside a longer candidate that has `cover`
    per cent of their places are left out. Null text counts as empty, null language is `und`. Repeated
    rows count as often as they stand. An empty table, or one without frequent phrases, gives no rows.
    Other columns are ignored.
    """
    counted = cut(phrase_counts(docs, least, order, text_col, lang_col))
    phrases = counted.where(F.size("words") > 0)
    long = phrases.where(F.size("words") > 1)
    # the best longer candidate around each phrase
    inner = F.filter(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.size("words") - 1),
                lambda k: F.transform(
                    F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k)
                ),
            )
        ),
        lambda p: F.size(p) > 1,
    )
    around = (
        long.where(F.size("words") > 2)
        .select("lang", F.explode(inner).alias("words"), "f")
        .groupBy("lang", "words")
        .agg(F.max("f").alias("around"))
    )
    wide = "cast({} as decimal(20, 0))"
    covered = F.expr(f"{wide.format('coalesce(around, 0)')} * 100 >= {wide.format('f')} * {cover}")
    candidates = cut(long.join(around, ["lang", "words"], "left").where(~covered).select("lang", "words", "f"))
    cuts = candidates.select(
        "lang",
        "words",
        F.col("f").alias("a"),
        F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"),
    ).select(
        "*",
        F.slice("words", F.lit(1), F.col("k")).alias("left"),
        F.slice("words", F.col("k") + 1, F.size("words")).alias("right"),
    )
    lefts = phrases.select("lang", F.col("words").alias("left"), F.col("f").alias("l"))
    rights = phrases.select("lang", F.col("words").alias("right"), F.col("f").alias("r"))
    # a first word may open a large part of all candidates; such keys are salted, none is broadcast
    both = attach(cuts, lefts, ["lang", "left"], broadcast_bytes=0)
    both = attach(both, rights, ["lang", "right"], broadcast_bytes=0)
    score = F.expr(f"cast({wide.format('a')} * {SCALE} div ({wide.format('l')} + {wide.format('r')}) as bigint)")
    worst = (
        both.select("lang", "words", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "words")
        .agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
        .select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    )
    ranking = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each of many shares first: no task holds all phrases of a language
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*ranking)
    best = worst.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*ranking)
    best = best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top)
    totals = counted.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def _oracle() -> str:
    counts = " UNION ALL ".join(
        f"SELECT lang, [{', '.join(f'ws[i + {j}]' for j in range(k))}] AS p, count(*) AS f FROM p "
        f"WHERE i + {k - 1} <= len(ws) GROUP BY ALL"
        for k in range(1, ORDER + 1)
    )
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
p AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM ({counts}) WHERE f >= {LEAST}),
g AS (SELECT lang, p, f, unnest([x for x in flatten([[p[i:i + k - 1] for i in range(1, len(p) - k + 2)]
             for k in range(2, len(p))])]) AS q
      FROM c WHERE len(p) > 2),
a AS (SELECT lang, q, max(f) AS f FROM g GROUP BY lang, q),
o AS (SELECT c.lang, c.p, c.f AS a FROM c LEFT JOIN a ON a.lang = c.lang AND a.q = c.p
      WHERE len(c.p) > 1 AND CAST(100 AS HUGEINT) * coalesce(a.f, 0) < CAST({COVER} AS HUGEINT) * c.f),
k AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM o),
b AS (SELECT k.lang, k.p, k.a, k.k, x.f AS l, y.f AS r,
             CAST(CAST({SCALE} AS HUGEINT) * k.a // (x.f + y.f) AS BIGINT) AS score
      FROM k JOIN c x ON x.lang = k.lang AND x.p = k.p[:k.k]
             JOIN c y ON y.lang = k.lang AND y.p = k.p[k.k + 1:]),
m AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM b
      QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= {TOP}"""


@query(_oracle())
def op12_collocations(spark, folder):
    return mine_collocations(table(spark, folder, "documents").select("lang", "text"))
