"""Merkle manifest of a dataset: cogrouped subtree exchange.

Each row is a leaf of its source's tree, and the sources' roots are the leaves of one more tree. A
run of `FAN` ** `DEPTH` consecutive leaves is a superblock. Superblocks are reduced to one node each,
those nodes form the next layer, and so on: a layer is thousands of times smaller than the one below.
Then the layers are walked down again: the nodes of a layer and the outer nodes that their
superblocks need are cogrouped by superblock, and one `applyInPandas` finishes the local reduction,
joins inner and outer siblings into proofs, and folds leaves to the root.

Places in a tree come from one range sort: rows are numbered inside their partition, and prefix sums
over partitions do the rest. No task holds a source; a superblock has `FAN` ** `DEPTH` rows at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from studyspark.llm.base import query, table
from studyspark.operators.lineage import cut

FAN = 3
DEPTH = 7  # levels of a superblock: 3^7 = 2187 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "path array<struct<left: string, right: string>>"


def field_text(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def _h(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def _numbered(sorted_rows: DataFrame) -> DataFrame:
    """Adds `pid`, `run` and `idx` to rows that each partition holds in order of `source`.

    `run` counts the stretches of one source within a partition, `idx` the rows within a run.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema)

    def number(batches):
        pid = TaskContext.get().partitionId()
        last, run, idx = None, -1, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            source = batch.column(batch.schema.get_field_index("source"))
            # null sources are one source; runs are told apart by neighbours
            filled, hole = pc.fill_null(source, ""), np.asarray(source.is_null())
            new = np.ones(n, bool)
            new[1:] = ~np.asarray(pc.equal(filled[1:], filled[:-1])) | (hole[1:] != hole[:-1])
            first = (source[0].as_py(),)
            new[0] = first != last
            runs = run + np.cumsum(new)
            starts = np.flatnonzero(new)
            at = np.arange(n)
            begin = np.zeros(n, np.int64)
            begin[starts] = starts
            begin = np.maximum.accumulate(begin)
            head = starts[0] if len(starts) else n
            ids = np.where(at < head, idx + at, at - begin)
            last, run, idx = (source[n - 1].as_py(),), int(runs[-1]), int(ids[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(runs), pa.array(ids)],
                [*batch.schema.names, "pid", "run", "idx"],
            )

    return sorted_rows.mapInArrow(number, f"{schema}, pid int, run bigint, idx bigint")


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their tree's number `tree`, place `pos` and size `n`; and (tree, source).

    `rows` is a written table of `_numbered`. The tables made here have a row per partition, or per
    partition and source in it.
    """
    runs = cut(rows.groupBy("pid", "run").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("size")))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)

    def ahead(per_pid: DataFrame, value: str) -> DataFrame:
        total = F.coalesce(F.sum(value).over(before), F.lit(0)).alias("ahead")
        return per_pid.select("pid", total)

    inside = Window.partitionBy("pid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ahead(runs.groupBy("pid").agg(F.sum("size").alias("size")), "size")
    begun = cut(
        runs.join(offsets, "pid").select(
            "pid", "run", "source", "size",
            (F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("begin"),
        )
    )
    # a source spans runs of several partitions; the first one gives its place among the sources
    trees = begun.groupBy(F.struct("source").alias("name")).agg(
        F.min("begin").alias("origin"), F.sum("size").alias("n"), F.min(F.struct("begin", "pid", "run")).alias("first")
    )
    opened = cut(trees.select("name", "origin", "n", F.col("first.pid").alias("pid"), F.col("first.run").alias("run")))
    opens_ahead = ahead(opened.groupBy("pid").agg(F.count(F.lit(1)).alias("opened")), "opened")
    nth = F.row_number().over(Window.partitionBy("pid").orderBy("run")) - 1
    trees = cut(
        opened.withColumn("nth", nth)
        .join(opens_ahead, "pid")
        .select("name", "origin", "n", (F.col("ahead") + F.col("nth")).alias("tree"))
    )
    of_run = begun.withColumn("name", F.struct("source")).join(trees, "name").select(
        "pid", "run", "tree", "n", (F.col("begin") - F.col("origin")).alias("skip")
    )
    placed = rows.join(of_run, ["pid", "run"]).withColumn("pos", F.col("skip") + F.col("idx"))
    return placed.drop("pid", "run", "idx", "skip"), trees.select("tree", "n", F.col("name.source").alias("source"))


def _levels(nodes: list[str], n: int, fan: int, depth: int) -> Iterator[list[str]]:
    """The levels above the leaves `nodes` of one superblock; `n` is the size of its whole tree.

    A tree that fits in one superblock ends at its root; else a superblock has all its levels.
    """
    alone = n <= fan**depth
    level = 0
    while (len(nodes) > 1) if alone else (level < depth):
        nodes = [_h("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
        level += 1
        yield nodes


def _tops(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """One node per superblock of nodes (tree, pos, n, hash), as nodes of the next layer."""
    size = fan**depth

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n, at = int(group["n"].iat[0]), group["hash"].tolist()
        for level in _levels(at, n, fan, depth):
            at = level
        return pd.DataFrame(
            {"tree": [group["tree"].iat[0]], "pos": [int(group["pos"].iat[0]) // size], "n": [-(-n // size)], "hash": at}
        )

    block = F.floor(F.col("pos") / F.lit(size)).alias("block")
    narrow = nodes.select("tree", "pos", "n", "hash", block)
    return cut(narrow.groupBy("tree", "block").applyInPandas(reduce, "tree bigint, pos bigint, n bigint, hash string"))


def _exchange(
    nodes: DataFrame, outer: DataFrame, carry: list[str], fan: int, depth: int, finish: Callable, schema: str
) -> DataFrame:
    """Cogroups nodes with the outer paths (tree, block, path, carry..) of their superblocks.

    `finish` turns the nodes of a superblock, each one's whole path, and the carried values into rows.
    """
    size = fan**depth

    def join(inner: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos").reset_index(drop=True)
        hashes, n = inner["hash"].tolist(), int(inner["n"].iat[0])
        levels = [hashes, *_levels(hashes, n, fan, depth)][:-1]  # a node on top has no siblings here
        rest = [(p["left"], p["right"]) for p in above["path"].iat[0]]
        paths = []
        for i in range(len(hashes)):
            path, at = [], i
            for level in levels:
                low = at - at % fan
                path.append(("".join(level[low:at]), "".join(level[at + 1 : low + fan])))
                at //= fan
            paths.append(path + rest)
        return finish(inner, paths, {c: above[c].iat[0] for c in carry})

    block = F.floor(F.col("pos") / F.lit(size)).alias("block")
    left = nodes.select("*", block).groupBy("tree", "block")
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def _steps(paths: list) -> list:
    return [[{"left": left, "right": right} for left, right in p] for p in paths]


def _descend(layers: list[DataFrame], outer: DataFrame, carry: list[str], fan: int, depth: int) -> DataFrame:
    """Outer paths for the superblocks of the layer below `layers`, from those of the top."""

    def hand_down(inner, paths, carried):
        return pd.DataFrame({"tree": inner["tree"], "block": inner["pos"], "path": _steps(paths), **carried})

    schema = ", ".join(["tree bigint, block bigint", _PATH, *[f"{c} string" for c in carry]])
    for nodes in reversed(layers):
        outer = cut(_exchange(nodes, outer, carry, fan, depth, hand_down, schema))
    return outer


def _layers(nodes: DataFrame, most: int, fan: int, depth: int) -> list[DataFrame]:
    """The layers above `nodes`, up to the one where each tree is a single node; `most` is the size
    of the largest tree."""
    out: list[DataFrame] = []
    while most > 1 or not out:
        nodes = _tops(nodes, fan, depth)
        most = -(-most // fan**depth)
        out.append(nodes)
    return out


def merkle_manifest(leaves: DataFrame, fan: int = FAN, depth: int = DEPTH, with_paths: bool = True) -> DataFrame:
    """Proofs of leaves (source, id, leaf, changed); `changed` is the leaf to fold, null for `leaf`.

    Returns (id, source, leaf, subroot, root, path, proof_sha256, folded_root, verified) per leaf, the
    path only if asked for. A source's leaves ascend by id (null first; of equal ids by hash, so rows
    that are equal take each other's place); sources ascend by their bytes, null first. `path` lists
    the siblings of each level from the leaf to the root, those on the left and those on the right.
    An empty table gives no rows and has no root. Other columns are ignored.
    """
    order = [F.col(c).asc_nulls_first() for c in ("source", "id", "leaf", "changed")]
    given = cut(leaves.select(F.col("source").cast("string").alias("source"), "id", "leaf", "changed"))
    rows = cut(_numbered(given.repartitionByRange(*order).sortWithinPartitions(*order)))
    kind = given.schema["id"].dataType
    placed, trees = _placed(rows)
    # ids go as text, as pandas would round large numbers beside nulls
    placed = cut(placed.select("tree", "pos", "n", F.col("id").cast("string").alias("id"), F.col("leaf").alias("hash"), "changed"))
    n_trees, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    below = _layers(placed, most or 0, fan, depth)
    # a source's root is a leaf of the upper tree
    roots = below[-1].select(
        F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("bigint").alias("n"), "hash"
    )
    upper = _layers(roots, n_trees, fan, depth)
    first = F.lit(0).cast("bigint").alias("block")
    none = F.array().cast(_PATH.split(" ", 1)[1]).alias("path")
    top = upper[-1].select("tree", first, none, F.col("hash").alias("root"))
    of_tree = _descend([roots, *upper[:-1]], top, ["root"], fan, depth)
    subroots = below[-1].select("tree", F.col("hash").alias("subroot"))
    outer = (
        of_tree.select(F.col("block").alias("tree"), first, "path", "root")
        .join(subroots, "tree")
        .join(trees.select("tree", "source"), "tree")
    )
    carry = ["root", "subroot", "source"]
    outer = _descend(below[:-1], outer, carry, fan, depth)

    def prove(inner, paths, carried):
        leaf, proofs, folded = inner["hash"].tolist(), [], []
        for own, other, path in zip(leaf, inner["changed"].tolist(), paths, strict=True):
            proofs.append(_h("".join(left + right for left, right in path)))
            at = other or own
            for left, right in path:
                at = _h(left + at + right)
            folded.append(at)
        out = {"id": inner["id"], "leaf": leaf, **carried, "proof_sha256": proofs, "folded_root": folded}
        if with_paths:
            out["path"] = _steps(paths)
        return pd.DataFrame(out)

    texts = ["id", "leaf", *carry, "proof_sha256", "folded_root"]
    schema = ", ".join([*[f"{c} string" for c in texts], *([_PATH] if with_paths else [])])
    proved = _exchange(placed, outer, carry, fan, depth, prove, schema)
    return proved.select(
        F.col("id").cast(kind).alias("id"), "source", "leaf", "subroot", "root",
        *(["path"] if with_paths else []),
        "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def document_leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """(source, id, leaf, changed) of every document; the first of `fields` is the id.

    `changed` gives other values for some fields; where none differs the leaf is the same and
    `changed` is null.
    """
    other = changed or {}
    leaf = leaf_hash(*[F.col(f"`{c}`") for c in fields])
    after = leaf_hash(*[other.get(c, F.col(f"`{c}`")) for c in fields])
    differs = F.lit(False)
    for c, value in other.items():
        differs = differs | ~value.eqNullSafe(F.col(f"`{c}`"))
    return docs.select(
        F.col("source"), F.col(f"`{fields[0]}`").alias("id"), leaf.alias("leaf"), F.when(differs, after).alias("changed")
    )


def _oracle(depth: int = 16) -> str:
    """Trees of up to 3^depth leaves and sources, level by level."""

    def tree(p: str, depth: int) -> str:
        out = []
        for k in range(1, depth + 1):
            out.append(f"""
{p}g{k} AS MATERIALIZED (SELECT tree, pos // {FAN} AS pos, max(n) AS n, list(h ORDER BY pos) AS hs FROM {p}{k - 1} GROUP BY ALL),
{p}{k} AS MATERIALIZED (SELECT tree, pos, CASE WHEN n > 1 THEN (n + {FAN - 1}) // {FAN} ELSE 1 END AS n,
        CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {p}g{k})""")
        walk = "\n".join(
            f"LEFT JOIN {p}g{k} x{k} ON x{k}.tree = z.tree AND x{k}.pos = z.pos // {FAN**k} AND x{k}.n > 1" for k in range(1, depth + 1)
        )
        steps = ", ".join(
            f"CASE WHEN x{k}.n IS NOT NULL THEN {{'l': array_to_string(x{k}.hs[:(z.pos // {FAN ** (k - 1)}) % {FAN}], ''), "
            f"'r': array_to_string(x{k}.hs[(z.pos // {FAN ** (k - 1)}) % {FAN} + 2:], '')}} END"
            for k in range(1, depth + 1)
        )
        out.append(f"""
{p}p AS MATERIALIZED (SELECT z.tree, z.pos, [s for s in [{steps}] if s IS NOT NULL] AS path
       FROM {p}0 z {walk})""")
        return ",".join(out)

    def leaf(text: str) -> str:
        cells = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(cells)})"

    bits = "flatten([[(ord(c) >> b) & 1 for b in range(8)] for c in string_split(CAST(doc_id AS VARCHAR), '')])"
    crc = f"""xor(list_reduce(list_concat([4294967295], [CAST(x AS BIGINT) for x in {bits}]),
       lambda c, b: CASE WHEN (c & 1) <> b THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
    return f"""
WITH d AS (SELECT *, CASE WHEN ({crc}) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM documents),
e AS (SELECT doc_id, source, {leaf("text")} AS h, {leaf("other")} AS o FROM d),
f AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
             count(*) OVER (PARTITION BY source) AS n FROM e),
a0 AS MATERIALIZED (SELECT tree, pos, n, h FROM f),{tree("a", depth)},
b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a{depth}),{tree("b", depth)},
j AS (SELECT f.*, list_concat(ap.path, bp.path) AS path, s.h AS subroot, r.h AS root
      FROM f JOIN ap USING (tree, pos) JOIN bp ON bp.pos = f.tree JOIN a{depth} s ON s.tree = f.tree CROSS JOIN b{depth} r),
w AS (SELECT *, list_reduce(list_concat([{{'l': o, 'r': ''}}], path),
                lambda c, s: {{'l': sha256(s.l || c.l || s.r), 'r': ''}}).l AS folded FROM j)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string([s.l || s.r for s in path], '')) AS proof_sha256,
       folded AS folded_root, folded = root AS verified
FROM w"""


@query(_oracle())
def op13_merkle_manifest(spark, folder):
    docs = table(spark, folder, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proved = merkle_manifest(document_leaves(docs, changed={"text": text}), with_paths=False)
    return proved.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    )
