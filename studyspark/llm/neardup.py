"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Every whole text becomes its set of shingles and `TREES` short MinHash sequences. Texts with
   equal sets are one node from here on, whatever their number.
2. Each tree sorts the nodes by their sequence. Nodes that share a prefix of `DEPTH` values form a
   region; inside it the next node in the order, the one with the longest common prefix, is a
   candidate. A crowded region is cut at a deeper prefix, and then by a hash, so no task sorts a
   large one; the heads of its pieces are candidates of each other in order.
3. Candidates are confirmed on full sets and joined to components.
4. In regions that still hold several components, every pair of nodes of different components that
   wasn't looked at is confirmed too, so what neighbours alone would miss is found: two texts that
   share one region in any tree are never left unchecked.

A pair of similarity s shares a region in some tree with chance 1 - (1 - s^DEPTH)^TREES: 0.99999 at
0.85 and 0.9998 at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyspark.llm.base import packed, query, table, text_key
from studyspark.llm.components import components
from studyspark.llm.wordbytes import Spans, chunks, mix, windows
from studyspark.operators.lineage import cut

TREES = 16
DEPTH = 4  # values that a region shares
DEEPER = 4  # further values that order it
LONGS = 16  # words of 64 bits in each set's summary
CROWD = 2_000  # nodes of a region from which it is cut deeper

_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(1, 2**63, TREES * (DEPTH + DEEPER), dtype=np.uint64) | np.uint64(1)
_MASKS = _draw.integers(1, 2**63, TREES * (DEPTH + DEEPER), dtype=np.uint64)


def shingle_sets(chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct shingles of document k are hashes[bounds[k]:bounds[k+1]].

    Texts with fewer words than a shingle have their whole word sequence as the only one.
    """
    start, end, own = chunk.words()
    word = Spans(chunk.lowered()).hash(start, end)
    count = np.bincount(own, minlength=chunk.n)
    first, gram = windows(word, own, words)
    at = [own[first]]
    grams = [gram]
    for size in range(1, words):
        first, gram = windows(word, own, size)
        short = count[own[first]] == size
        at.append(own[first][short])
        grams.append(gram[short])
    at, grams = np.concatenate(at), np.concatenate(grams)
    order = np.argsort(at, kind="stable")
    at, grams = at[order], grams[order]
    edges = np.searchsorted(at, np.arange(chunk.n + 1))
    sets = [np.unique(grams[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else grams), bounds


def _signatures(hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint bytes, regions, orders) of the non-empty sets that begin at `heads`."""
    low = np.empty((len(heads), TREES * (DEPTH + DEEPER)), np.uint64)
    for j, (factor, mask) in enumerate(zip(_FACTORS, _MASKS, strict=True)):
        low[:, j] = np.minimum.reduceat(((hashes ^ mask) * factor) >> np.uint64(32), heads)
    low = low.reshape(len(heads), TREES, DEPTH + DEEPER)
    region = np.zeros((len(heads), TREES), np.uint64)
    for d in range(DEPTH):
        region = mix(region + low[:, :, d] + np.uint64(1))
    region = mix(region + np.arange(TREES, dtype=np.uint64))
    order = np.zeros((len(heads), TREES), np.uint64)
    for d in range(DEPTH, DEPTH + DEEPER):
        order = (order << np.uint64(16)) | (low[:, :, d] & np.uint64(0xFFFF))
    sums = [np.add.reduceat(mix(hashes ^ np.uint64(s)), heads) for s in (0x51, 0xA3)]
    return np.column_stack(sums).astype("<u8"), region.view(np.int64), order.view(np.int64)


def _summaries(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits times LONGS of each set, as whole numbers: one bit is set for each shingle."""
    bits = np.zeros((len(size), 64 * LONGS), bool)
    bits[np.repeat(np.arange(len(size)), size), (hashes % np.uint64(64 * LONGS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _lists(values: np.ndarray, full: np.ndarray) -> pa.Array:
    """One list per document; documents outside `full` get an empty one."""
    size = np.where(full, values.shape[1], 0)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def sign_documents(rows: DataFrame, words: int) -> DataFrame:
    """(key, n_shingles, node, regions, orders, bits) of rows (key, text); node is null without words."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for chunk in chunks(batch.column(1)):
                hashes, bounds = shingle_sets(chunk, words)
                size = np.diff(bounds)
                full = size > 0
                marks, region, order = _signatures(hashes, bounds[:-1][full])
                raw = marks.tobytes()
                place = np.cumsum(full) - 1
                node = [raw[16 * p : 16 * p + 16] if f else None for f, p in zip(full, place, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(chunk.first, chunk.n),
                        pa.array(size.astype(np.int64)),
                        pa.array(node, pa.binary()),
                        _lists(region, full),
                        _lists(order, full),
                        _lists(_summaries(hashes, size[full]), full),
                    ],
                    ["key", "n_shingles", "node", "regions", "orders", "bits"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(
        run,
        f"key {kind}, n_shingles bigint, node binary, regions array<bigint>, orders array<bigint>, "
        "bits array<bigint>",
    )


def node_sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                hashes, bounds = shingle_sets(chunk, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.n),
                        pa.ListArray.from_arrays(
                            pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))
                        ),
                    ],
                    ["node", "shingles"],
                )

    return rows.select("node", "text").mapInArrow(run, "node binary, shingles array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - shared
    return (
        pairs.join(left, "a").join(right, "b").where(100 * shared >= percent * union).select("a", "b")
    )


def neighbours(entries: DataFrame) -> DataFrame:
    """Candidate pairs (a, b): next nodes in each region's order, and next heads of its pieces.

    entries: (region, node, n, order, crowd); `crowd` is the size of the region.
    """
    deep = F.when(F.col("crowd") > CROWD, F.shiftrightunsigned("order", 48)).otherwise(0)
    cut_deep = entries.withColumn("deep", deep)
    many = (
        cut_deep.where(F.col("crowd") > CROWD)
        .groupBy("region", "deep")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > CROWD)
    )
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / CROWD))
    pieces = cut_deep.join(many, ["region", "deep"], "left").withColumn(
        "salt", F.coalesce(salt, F.lit(0))
    )
    near = Window.partitionBy("region", "deep", "salt").orderBy("order", "node")
    inside = pieces.select("node", F.lead("node").over(near).alias("next"))
    heads = (
        pieces.where(F.col("crowd") > CROWD)
        .groupBy("region", "deep", "salt")
        .agg(F.min("node").alias("node"))
    )
    along = Window.partitionBy("region").orderBy("deep", "salt")
    between = heads.select("node", F.lead("node").over(along).alias("next"))
    return (
        inside.union(between)
        .where(F.col("next").isNotNull())
        .select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b"))
        .distinct()
    )


def unchecked(entries: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one region but different components.

    The component with most nodes of a region is met only by the region's other nodes, so a large
    group that is joined already costs nothing. A pair comes from the first tree only in which it
    shares a region. Pairs that can't reach the similarity are skipped by an exact bound: each bit
    that differs between two summaries stands for at least one shingle that one of them lacks.
    """
    joined = entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = joined.groupBy("region", "root").agg(F.count(F.lit(1)).alias("nodes"))
    open_regions = (
        held.groupBy("region")
        .agg(
            F.count(F.lit(1)).alias("kinds"),
            F.max(F.struct("nodes", "root")).getField("root").alias("main"),
        )
        .where(F.col("kinds") > 1)
        .select("region", "main")
    )
    summary = nodes.select("node", *[F.get("bits", F.lit(k)).alias(f"bits{k}") for k in range(LONGS)])
    rows = cut(joined.join(open_regions, "region").join(summary, "node"))
    loose = rows.where(F.col("root") != F.col("main")).select(
        "region",
        F.col("node").alias("a"),
        F.col("n").alias("n_a"),
        F.col("root").alias("root_a"),
        F.col("tree").alias("tree"),
        F.col("regions").alias("regions_a"),
        *[F.col(f"bits{k}").alias(f"a{k}") for k in range(LONGS)],
    )
    others = rows.select(
        "region",
        F.col("node").alias("b"),
        F.col("n").alias("n_b"),
        F.col("root").alias("root_b"),
        (F.col("root") == F.col("main")).alias("in_main"),
        F.col("regions").alias("regions_b"),
        *[F.col(f"bits{k}").alias(f"b{k}") for k in range(LONGS)],
    )
    apart = sum(F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(LONGS))
    both = F.col("n_a") + F.col("n_b")
    # shared <= (both - apart) / 2, and shared * (100 + percent) >= percent * both is asked for
    fits = (both - apart) * (100 + percent) >= 2 * percent * both
    earlier = F.size(F.array_intersect(F.slice("regions_a", F.lit(1), F.col("tree")), "regions_b"))
    met = loose.join(others, "region").where(
        (F.col("root_a") != F.col("root_b"))
        & (F.col("in_main") | (F.col("a") < F.col("b")))
        & fits
        & (earlier == 0)
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(key, n_shingles, component_id) for every row of `docs`; key is `text_key` of the row.

    Two texts are linked if 100 * shared shingles >= percent * all shingles of both. component_id
    is the smallest non-null id that links reach. Null and empty texts, and texts of white space,
    have no shingle, are linked with nothing and keep their own id. Rows that share an id are
    separate texts; a null id takes part, and its component_id is null if no linked row has one.
    """
    rows = docs.select(
        text_key(F.col(id_col), F.col(text_col).cast("string")).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    signed = cut(sign_documents(rows, words))
    nodes = cut(
        signed.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min("key.id").alias("low"),
            F.min("key").alias("key"),
            F.first("n_shingles").alias("n"),
            F.first("regions").alias("regions"),
            F.first("orders").alias("orders"),
            F.first("bits").alias("bits"),
        )
    )
    spread = nodes.select(
        "node",
        "n",
        "regions",
        F.explode(F.arrays_zip("regions", "orders", F.sequence(F.lit(0), F.lit(TREES - 1)).alias("t"))).alias("e"),
    ).select(
        "node", "n", "regions", F.col("e.regions").alias("region"), F.col("e.orders").alias("order"), F.col("e.t").alias("tree")
    )
    shared = spread.groupBy("region").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > 1)
    entries = cut(spread.join(shared, "region"))
    wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", "key")
    sets = cut(node_sets(rows.join(wanted, "key").dropDuplicates(["node"]), words))
    first = cut(confirmed(neighbours(entries), sets, percent))
    roots = components(first)
    rest = cut(confirmed(unchecked(entries, roots, nodes, percent), sets, percent))
    if not rest.isEmpty():
        roots = components(first.union(rest))
    lows = (
        nodes.join(roots, "node", "left")
        .select("node", "low", F.coalesce("root", "node").alias("root"))
    )
    least = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    named = lows.join(least, "root").select("node", "component_id")
    linked = signed.select("key", "n_shingles", "node").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("key.id")).otherwise(F.col("component_id"))
    return linked.select("key", "n_shingles", own.alias("component_id"))


def keep_one(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns as they are, that stand for their component.

    The row with the smallest id stays; of rows with equal id and text one stays. Rows without
    words all stay, and so do rows with null ids whose component has no other id.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col)
    kept = found.where(F.col("key.id").eqNullSafe(F.col("component_id"))).select("key").distinct()
    rows = packed(docs, key=text_key(F.col(id_col), F.col(text_col).cast("string")))
    return rows.join(kept, "key").dropDuplicates(["key"]).select("row.*")


_ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
           END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
      FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.doc_id AND r.c < both_ways.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id,
       d.doc_id = min(r.c) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""


@query(_ORACLE)
def op6_near_duplicates(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"), words=3, percent=85)
    return found.select(
        F.col("key.id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.col("key.id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
