"""Benchmark decontamination on typed templates.

Numbers, names and units of a text become typed placeholders, so a question with other numbers or
names keeps its template. Hashes of template windows are joined between documents and benchmark
items; what filled the placeholders must map from item to document the same way all along a
passage. A capital that opens a sentence may be a name or not, so its windows stand in both ways.
Windows of the plain words are joined beside them, so a copy with other capitals counts.

A window that many items and many documents share would join all of them. So documents and items
first meet on each item's rarest windows only: a document that holds a share s of an item's n windows
holds one of any n - s n + 1 of them. All windows are then compared for the pairs that met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studyspark.llm.base import packed, query, table, text_key
from studyspark.llm.wordbytes import Spans, chunks, mix
from studyspark.operators.lineage import cut

WINDOW = 5
LEAST_LITERAL = 2  # words of a window that must not be placeholders
SHARE = 0.8  # of an item's windows that make a document contaminated
SLOT_FAULTS = 0.2  # of an item's slots that may change their filling within a passage
LEAST_BAND = 16  # diagonals that count as near for any item, however short
FILTER_BITS = 25  # the window filter has 2^25 bits, 4 MB, whatever the benchmark

UNITS = (
    "am", "cent", "centimeters", "centimetres", "cents", "cm", "day", "days", "degrees", "dollar",
    "dollars", "euro", "euros", "feet", "foot", "ft", "g", "gallons", "gram", "grams", "h", "hour",
    "hours", "inch", "inches", "kg", "kilogram", "kilograms", "kilometers", "kilometres", "km",
    "kmh", "l", "lb", "lbs", "liter", "liters", "litre", "litres", "m", "meter", "meters", "metre",
    "metres", "mg", "mile", "miles", "min", "minute", "minutes", "ml", "mm", "month", "months",
    "mph", "ounces", "percent", "pm", "pound", "pounds", "s", "second", "seconds", "ton", "tons",
    "week", "weeks", "yard", "yards", "year", "years",
)
_NUMBER, _NAME, _UNIT = (np.uint64(0x1F0A3C5D7E9B1101 + k) for k in range(3))
_BASE = 0xB5297A4D3F84D5B5
# Bits of a filling: the lowest is set in all, the second in all but words that open a sentence.
_FILLED, _INNER = np.uint64(1), np.uint64(2)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:;\n\r"]] = True
_CAPITALS = np.array([chr(k).isupper() for k in range(0x20000)])


def _unit_hashes() -> np.ndarray:
    out = []
    for unit in UNITS:
        data = np.frombuffer(unit.encode(), np.uint8)
        out.append(Spans(data).hash(np.array([0]), np.array([len(data)]))[0])
    return np.sort(np.array(out, np.uint64))


def _capitals(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Does the code point at each start belong to the capitals of any alphabet?"""
    last = max(len(data) - 1, 0)
    b = [data[np.minimum(start + k, last)].astype(np.int64) for k in range(4)]
    tail = [x & 0x3F for x in b]
    point = np.select(
        [b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0],
        [b[0], (b[0] & 0x1F) << 6 | tail[1], (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2]],
        (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3],
    )
    return (point < len(_CAPITALS)) & _CAPITALS[np.minimum(point, len(_CAPITALS) - 1)]


def _templates(chunk, units: np.ndarray):
    """(document, plain hash, [(template hash, filling), ...], opener) of each term.

    A literal has filling 0. In the first template a capital that opens a sentence is a literal, in
    the second one a name; `opener` says where they differ.
    """
    start, end, own = chunk.terms()
    data = chunk.data
    plain = Spans(chunk.lowered()).hash(start, end)
    digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    number = digit[end] > digit[start]
    capital = _capitals(data, start)
    # a term opens a sentence at a document's start or if a sentence end stands before it
    stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
    opens = np.ones(len(start), bool)
    opens[1:] = (own[1:] != own[:-1]) | (stops[start[1:]] > stops[end[:-1]])
    capital &= ~number
    follows = np.zeros(len(start), bool)
    follows[1:] = number[:-1] & (own[1:] == own[:-1])
    maybe = np.flatnonzero(follows)
    at = np.minimum(np.searchsorted(units, plain[maybe]), len(units) - 1)
    follows[maybe] = units[at] == plain[maybe]
    out = []
    for name in (capital & ~opens, capital):
        unit = follows & ~name & ~number
        typed = plain.copy()
        for mask, code in ((number, _NUMBER), (name, _NAME), (unit, _UNIT)):
            typed[mask] = code
        kept = np.where(name & opens, (plain | _FILLED) & ~_INNER, plain | _FILLED | _INNER)
        out.append((typed, np.where(number | name | unit, kept, np.uint64(0))))
    return own, plain, out, capital & opens


def _rolled(values: np.ndarray, width: int, salt: int) -> np.ndarray:
    n = len(values) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += values[k : k + n] * np.uint64(pow(_BASE, k, 2**64))
    return mix(total + np.uint64(salt + 2 * (WINDOW - width)))


def _windows_of(chunk, units: np.ndarray, widths: tuple[int, ...] | None):
    """(document, position, width, typed?, hash, fillings) of the template and the plain windows.

    `widths` lists the widths in use; None gives windows of `WINDOW` words, and one window of the
    whole text where it has fewer words.
    """
    own, plain, templates, opener = _templates(chunk, units)
    first = np.searchsorted(own, np.arange(chunk.n))
    words = np.bincount(own, minlength=chunk.n)
    parts = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros((0, WINDOW), np.uint64)]]
    for width in widths or range(1, WINDOW + 1):
        n = len(own) - width + 1
        if n <= 0:
            continue
        inside = own[:n] == own[width - 1 :]
        if widths is None and width < WINDOW:
            inside &= words[own[:n]] == width
        if not inside.any():
            continue
        view = lambda x, w=width: np.lib.stride_tricks.sliding_window_view(x, w)
        at = np.flatnonzero(inside)
        none = np.zeros((len(at), WINDOW), np.uint64)
        parts.append([at, np.full(len(at), width), np.zeros(len(at), bool), _rolled(plain, width, 1)[at], none])
        for which, (typed, filling) in enumerate(templates):
            literal = (view(filling) == 0).sum(axis=1)
            # a template window counts where it holds a placeholder; all others are plain windows
            use = inside & (literal >= LEAST_LITERAL) & (literal < width)
            if which:
                use &= view(opener).any(axis=1)
            at = np.flatnonzero(use)
            slots = np.zeros((len(at), WINDOW), np.uint64)
            slots[:, :width] = view(filling)[at]
            parts.append([at, np.full(len(at), width), np.ones(len(at), bool), _rolled(typed, width, 2)[at], slots])
    at, width, is_typed, hashes, slots = (np.concatenate(x) for x in zip(*parts, strict=True))
    return own[at], at - first[own[at]], width, is_typed, hashes.view(np.int64), slots.view(np.int64)


def template_windows(
    rows: DataFrame, seen: bytes | None = None, widths: tuple[int, ...] | None = None
) -> DataFrame:
    """(key, pos, width, typed, hash, slots) of all windows of rows (key, text).

    `seen` is a bit table of hashes; windows outside it are left out, as they can't match. `widths`
    are the widths to look at; without it a text under `WINDOW` words is one window.
    """
    units = _unit_hashes()
    bits = None if seen is None else np.frombuffer(seen, np.uint8)

    def run(batches):
        for batch in batches:
            keys = batch.column(0)
            for chunk in chunks(batch.column(1)):
                found = _windows_of(chunk, units, widths)
                if bits is not None:
                    low = found[4] & ((1 << FILTER_BITS) - 1)
                    keep = np.flatnonzero((bits[low >> 3] >> (low & 7)) & 1)
                    found = [x[keep] for x in found]
                own, pos, width, typed, hashes, slots = found
                if not len(own):
                    continue
                offsets = np.arange(len(slots) + 1, dtype=np.int32) * WINDOW
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(own + chunk.first)),
                        pa.array(pos.astype(np.int64)),
                        pa.array(width.astype(np.int32)),
                        pa.array(typed),
                        pa.array(hashes),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(slots.ravel())),
                    ],
                    ["key", "pos", "width", "typed", "hash", "slots"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text").mapInArrow(
        run, f"key {kind}, pos bigint, width int, typed boolean, hash bigint, slots array<bigint>"
    )


def _bit_table(hashes: DataFrame) -> bytes:
    """2^FILTER_BITS bits, set for each hash's low bits; as large for any benchmark."""
    low = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    parts = (
        hashes.select(low.alias("low"))
        .groupBy(F.expr("bitmap_bucket_number(low + 1)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(low + 1))").alias("bits"))
        .collect()
    )
    out = bytearray(1 << (FILTER_BITS - 3))
    size = 4096
    for r in parts:
        at = (r["bucket"] - 1) * size
        out[at : at + size] = bytes(r["bits"])[: len(out) - at]
    return bytes(out)


def _rarest(items: DataFrame, sizes: DataFrame, filled: DataFrame, share: float) -> DataFrame:
    """(item, hash) of the windows of which a document with `share` of the item holds at least one.

    `sizes` holds each item's number of positions. Those that the fewest windows of documents match
    are taken, so what they join is as little as it can be.
    """
    held = filled.groupBy("hash").agg(F.count(F.lit(1)).alias("held"))
    places = (
        items.join(held, "hash", "left")
        .groupBy("item", "ipos")
        .agg(F.sum(F.coalesce("held", F.lit(0))).alias("held"))
        .join(sizes, "item")
    )
    # shares are rounded to six digits before they are compared
    least = F.greatest(F.ceil(F.col("all") * (share - 1e-6)), F.lit(1))
    order = Window.partitionBy("item").orderBy("held", "ipos")
    rare = places.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("all") - least + 1)
    return (
        items.join(rare.where("held > 0").select("item", "ipos"), ["item", "ipos"])
        .select("item", "hash")
        .distinct()
    )


def benchmark_matches(
    rows: DataFrame,
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    least: float = SHARE,
) -> DataFrame:
    """(key, item, share): the part of an item's windows that a passage of a document holds.

    Pairs whose share is below `least` aren't listed; the lower it is, the more pairs are compared.
    A window counts if its plain words (numbers as they are) or one of its templates stand in the
    document. Along one diagonal (document position minus item position) each filling of the item
    must stand for one filling of the document; where over `SLOT_FAULTS` of them don't, the
    diagonal's template windows don't count. Windows add up over diagonals that lie near each
    other, by up to the item's length, so windows from unrelated places don't. An item under five
    words is one window.
    """
    items = cut(
        template_windows(
            benchmark.select(F.col(item_col).alias("key"), F.col(text_col).cast("string").alias("text"))
        ).withColumnsRenamed({"key": "item", "pos": "ipos", "slots": "islots"})
    )
    sizes = items.groupBy("item").agg(F.countDistinct("ipos").alias("all"))
    widths = tuple(sorted(r["width"] for r in items.select("width").distinct().collect())) or (WINDOW,)
    filled = cut(template_windows(rows, _bit_table(items), widths).drop("width"))
    pairs = filled.join(_rarest(items, sizes, filled, least), "hash").select("key", "item").distinct()
    met = cut(
        pairs.join(items.drop("typed", "width"), "item")
        .join(filled, ["key", "hash"])
        .withColumn("diag", F.col("pos") - F.col("ipos"))
    )
    # an opening word that is the same on both sides tells nothing about the names
    inner = F.lit(int(_INNER))
    opener = (F.col("s.islots").bitwiseAND(inner) == 0) & (F.col("s.slots").bitwiseAND(inner) == 0)
    slots = (
        met.where("typed")
        .select("key", "item", "diag", F.explode(F.arrays_zip("islots", "slots")).alias("s"))
        .where(F.col("s.islots") != 0)
        .where(~(opener & (F.col("s.islots") == F.col("s.slots"))))
        .select(
            "key", "item", "diag",
            F.col("s.islots").bitwiseOR(inner).alias("slot"),
            F.col("s.slots").bitwiseOR(inner).alias("filling"),
        )
        .groupBy("key", "item", "diag", "slot")
        .agg((F.min("filling") != F.max("filling")).cast("int").alias("fault"))
        .groupBy("key", "item", "diag")
        .agg((F.avg("fault") > SLOT_FAULTS).alias("broken"))
        .where("broken")
    )
    good = met.join(slots, ["key", "item", "diag"], "left").where(
        ~F.col("typed") | F.col("broken").isNull()
    )
    # ranges of diagonals that overlap by half: any two that are near share one
    band = F.floor(F.col("diag") / F.greatest(F.col("all"), F.lit(LEAST_BAND)))
    return (
        good.select("key", "item", "ipos", "diag")
        .distinct()
        .join(sizes, "item")
        .select("key", "item", "ipos", "all", F.explode(F.array(band, band - 1)).alias("band"))
        .groupBy("key", "item", "band", "all")
        .agg(F.countDistinct("ipos").alias("found"))
        .groupBy("key", "item")
        .agg(F.round(F.max(F.col("found") / F.col("all")), 6).alias("share"))
        .where(F.col("share") >= least)
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(key, contaminated, item, share, n_items) of every row of `docs`; key is `text_key`.

    `item` is the item with the largest share (ties: the smallest) and `n_items` counts the items, of
    those that reach `share`; where none does, item is null and share 0. Null and empty texts share
    nothing. An empty
    benchmark leaves every document clean. Equal rows are each returned.
    """
    rows = docs.select(
        text_key(F.col(id_col), F.col(text_col).cast("string")).alias("key"),
        F.col(text_col).cast("string").alias("text"),
    )
    found = benchmark_matches(rows, benchmark, item_col, least=share)
    best = found.groupBy("key").agg(
        F.min_by("item", F.struct(-F.col("share"), "item")).alias("item"),
        F.max("share").alias("share"),
        F.count(F.lit(1)).alias("n_items"),
    )
    return rows.select("key").join(best, "key", "left").select(
        "key",
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        "item",
        F.coalesce("share", F.lit(0.0)).alias("share"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """The rows of `docs`, all columns as they are, that hold no benchmark item."""
    key = text_key(F.col(id_col), F.col(text_col).cast("string"))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    bad = benchmark_matches(rows, benchmark, item_col, least=share).select("key").distinct()
    return packed(docs, key=key).join(bad, "key", "left_anti").select("row.*")


@query()
def op2_decontamination(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        F.col("key.id").alias("doc_id"),
        "contaminated",
        F.col("item").alias("item_id"),
        "share",
        "n_items",
    )
