"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Lexicon voters come from a seed list and from words and word beginnings mined from labelled rows;
pattern voters look at form. Every document's votes are one bit mask, so the label model sees the
whole corpus as counts per mask. It is fitted by expectation maximisation: each voter fires with
its own rate in toxic and in clean documents, and voters that agree more than these rates explain
are tied in a forest of pairwise dependencies. A logistic classifier is then trained on the
posterior labels of all documents and scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.llm.base import id_remainder, packed, query, table
from studyspark.llm.wordbytes import Chunk, Spans, chunks
from studyspark.operators.lineage import cut

SEEDS = (
    "clown", "disgusting", "dumb", "filthy", "fool", "garbage", "hate", "idiot", "imbecile", "jerk",
    "loser", "moron", "pathetic", "retard", "scum", "stupid", "trash", "ugly", "vermin",
    "worthless",
)
# Labelled rows of each class that the lexicon is mined from: a hash-chosen sample of this size.
MINE_ROWS = 6_000
# A piece is strong (weak) if it stands in at least MIN_DOCS toxic texts and its rate there is this
# many times its rate in clean ones. The lexicon keeps all of them: the sample bounds their number.
STRONG, WEAK, MIN_DOCS = 20.0, 5.0, 3
PREFIXES = (4, 5, 6, 7, 8)
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
EM_ROUNDS = 60
NEWTON_ROUNDS = 8
PENALTY = 1.0
TIE = 0.02  # conditional mutual information, in nats, from which two voters are tied

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of each group of pieces, and the pieces themselves."""

    pieces: dict[str, list[str]]

    def tables(self) -> dict[str, np.ndarray]:
        return {
            k: np.unique(np.array([_hash_text(p) for p in v], dtype=np.uint64))
            for k, v in self.pieces.items()
        }


def _hash_text(piece: str) -> int:
    data = np.frombuffer(piece.encode(), np.uint8)
    return int(Spans(data).hash(np.array([0]), np.array([len(data)]))[0])


# What is counted in a text, and from which count a voter fires.
HITS = ("seed", "word_a", "word_b", "word_c", "word_weak", "prefix", "prefix_weak", "dense", "dense_prefix", "shout", "bang", "masked")
VOTERS = (
    ("seed", 1), ("seed", 2), ("word_a", 1), ("word_b", 1), ("word_c", 1), ("word_weak", 1),
    ("prefix", 1), ("prefix", 2), ("prefix_weak", 2), ("dense", 10), ("dense_prefix", 12), ("shout", 20), ("bang", 3), ("masked", 1),
)
LEXICON_VOTERS = 11  # the first ones
# Rate of a vote in (clean, toxic) texts before any is seen, and how many texts that is worth.
LEXICON_PRIOR = ((0.02, 0.5), (20.0, 4.0))
PATTERN_PRIOR = ((0.05, 0.1), (2.0, 2.0))
FEATURES = (*HITS, "log_terms")


def mine_lexicon(texts: DataFrame, known: DataFrame) -> Lexicon:
    """Pieces of the texts (id, text) that mark toxic ones among the labels (id, label).

    A hash of the id picks about `MINE_ROWS` labels of each class. That sample is small whatever
    the corpus, so it goes to the texts; they are read whole and never moved.
    """
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({"seed": list(SEEDS), **{k: [] for k in HITS[1:7]}})
    chance = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("label") == 1, MINE_ROWS / sizes[1]).otherwise(MINE_ROWS / sizes[0])
    picked = F.broadcast(known.where(chance < share).select("id", "label"))
    sample = cut(texts.join(picked, "id").select(F.lower("text").alias("text"), "label"))
    count = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = max(count.get(1, 0), 1), max(count.get(0, 0), 1)
    words = sample.withColumn(
        "w", F.array_distinct(F.regexp_extract_all("text", F.lit(_TERM), 0))
    ).select("label", "w")

    def beginnings(size):
        long = F.filter("w", lambda x: F.length(x) > size)
        return F.array_distinct(F.transform(long, lambda x: F.substring(x, 1, size)))

    def marked(kind, column):
        return F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("piece")))

    groups = [marked("word", F.col("w")), *[marked(f"first {n}", beginnings(n)) for n in PREFIXES]]
    pieces = words.select("label", F.explode(F.concat(*groups)).alias("p"))
    ratio = ((F.col("bad") + 0.1) / toxic) / ((F.col("good") + 0.5) / clean)
    found = cut(
        pieces.groupBy("p.kind", "p.piece")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .where((F.col("bad") >= MIN_DOCS) & (ratio >= WEAK))
        .withColumn("ratio", ratio)
    )
    strong = found.where(F.col("ratio") >= STRONG)
    best = [F.col("ratio").desc(), F.col("bad").desc(), "kind", "piece"]
    out: dict[str, list[str]] = {"seed": list(SEEDS), **{k: [] for k in HITS[1:7]}}

    def rows(df, words_only):
        kind = F.col("kind") == "word"
        return df.where(kind if words_only else ~kind).orderBy(*best).collect()

    for r in rows(strong, True):
        out[f"word_{'abc'[_hash_text(r['piece']) % 3]}"].append(r["piece"])
    out["word_weak"] = [r["piece"] for r in rows(found.where(F.col("ratio") < STRONG), True)]
    out["prefix"] = [r["piece"] for r in rows(strong, False)]
    out["prefix_weak"] = [r["piece"] for r in rows(found.where(F.col("ratio") < STRONG), False)]
    return Lexicon(out)


class _Lookup:
    """Membership of hashes: one probe of a bit table sorts out almost all of them."""

    def __init__(self, members: np.ndarray):
        self._members = members
        self._seen = np.zeros(1 << 18, bool)
        self._seen[(members >> np.uint64(46)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        out = self._seen[(hashes >> np.uint64(46)).astype(np.int64)]
        maybe = np.flatnonzero(out)
        if len(maybe) and len(self._members):
            at = np.searchsorted(self._members, hashes[maybe])
            at[at == len(self._members)] = 0
            out[maybe] = self._members[at] == hashes[maybe]
        return out


def _count(chunk: Chunk, low: Chunk, find: dict[str, _Lookup]) -> np.ndarray:
    """Counts of the documents of `chunk`; `low` holds the same ones in small letters."""
    n, data = low.n, low.data
    start, end, own = low.terms()
    by = lambda mask: np.bincount(own[mask], minlength=n).astype(float)
    spans = Spans(data)
    word = spans.hash(start, end)
    out = {k: by(find[k].hits(word)) for k in ("seed", "word_a", "word_b", "word_c", "word_weak")}
    lead = (data & 0xC0) != 0x80
    ahead = np.concatenate([[0], np.cumsum(lead)])
    place = np.append(np.flatnonzero(lead), len(data))
    first, most = ahead[start], ahead[end]
    strong, weak = np.zeros(len(start), bool), np.zeros(len(start), bool)
    for size in PREFIXES:
        long = np.flatnonzero(most - first > size)
        if len(long):
            got = spans.hash(start[long], place[first[long] + size])
            strong[long] |= find["prefix"].hits(got)
            weak[long] |= find["prefix_weak"].hits(got)
    out["prefix"], out["prefix_weak"] = by(strong), by(weak)
    # hits in a thousand terms, of texts with two hits or more
    size = np.maximum(np.bincount(own, minlength=n), 1)
    found = out["seed"] + out["word_a"] + out["word_b"] + out["word_c"]
    out["dense"] = np.where(found >= 2, 1000 * found / size, 0)
    out["dense_prefix"] = np.where(out["prefix"] >= 2, 1000 * out["prefix"] / size, 0)
    # form is that of the text as it stands
    data = chunk.data
    start, end, own = chunk.terms()
    upper = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    length = end - start
    out["shout"] = by((length >= 4) & (upper[end] - upper[start] == length))
    bang = np.flatnonzero((data[1:] == 0x21) & (data[:-1] == 0x21)) if len(data) else []
    out["bang"] = np.bincount(chunk.owner(bang), minlength=n).astype(float) if len(bang) else np.zeros(n)
    # letters on both sides of a masking sign: st*pid, m0ron
    digits = digit[end] - digit[start]
    inner = (digits == 1) & (length >= 4) & (digit[end] == digit[end - 1]) & (digit[start + 1] == digit[start])
    star = np.zeros(len(start), bool)
    if len(start) > 1:
        joint = (start[1:] == end[:-1] + 1) & np.isin(data[np.minimum(end[:-1], len(data) - 1)], [0x2A, 0x40, 0x24])
        star[1:] = joint & (own[1:] == own[:-1])
    out["masked"] = by(inner | star)
    out["log_terms"] = np.log1p(np.bincount(own, minlength=n))
    return np.column_stack([out[k] for k in FEATURES])


def count_hits(text: Column, lexicon: Lexicon) -> Column:
    """array<double> of `FEATURES` of each whole text; null counts as empty.

    A-Z, and capitals of other alphabets, count as small letters for the lexicon, which is mined from
    texts in the same small letters.
    """
    tables = lexicon.tables()

    @F.arrow_udf("array<double>")
    def hits(texts: pa.Array, small: pa.Array) -> pa.Array:
        find = {k: _Lookup(v) for k, v in tables.items()}
        parts = []
        for c in chunks(texts):
            # the same documents in one chunk, whatever length their small letters have
            (low,) = chunks(small.slice(c.first, c.n), 1 << 62)
            parts.append(_count(c, low, find))
        out = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        offsets = np.arange(len(out) + 1, dtype=np.int32) * len(FEATURES)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    text = text.cast("string")
    return hits(text, F.lower(text))


def vote_mask(hits: Column) -> Column:
    """One bit for each voter that fires."""
    bits = [
        F.when(hits[FEATURES.index(name)] >= least, F.lit(1 << k)).otherwise(0)
        for k, (name, least) in enumerate(VOTERS)
    ]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total.cast("int")


@dataclass
class LabelModel:
    """P(toxic) and, for every voter, its rates given the class and given its parent's vote."""

    prior: float
    parent: list[int]  # of each voter; -1: none
    rate: np.ndarray  # [voter, parent's vote, class]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes = votes.astype(int)
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            r = self.rate[j][given]
            log += np.where(votes[:, [j]] == 1, np.log(r), np.log(1 - r))
        log -= log.max(axis=1, keepdims=True)
        odds = np.exp(log)
        return odds[:, 1] / odds.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """Chance that a voter is right: fires on toxic, stays silent on clean."""
        r = self.rate.mean(axis=1)
        return self.prior * r[:, 1] + (1 - self.prior) * (1 - r[:, 0])


def _tied(votes: np.ndarray, mass: np.ndarray) -> list[int]:
    """Parents of a maximum forest over conditional mutual information given the class."""
    m = votes.shape[1]
    total = mass.sum()
    edges = []
    for a in range(m):
        for b in range(a):
            info = 0.0
            for y in (0, 1):
                w = mass[:, y]
                for va in (0, 1):
                    for vb in (0, 1):
                        both = w[(votes[:, a] == va) & (votes[:, b] == vb)].sum()
                        one = w[votes[:, a] == va].sum()
                        two = w[votes[:, b] == vb].sum()
                        if both > 0:
                            info += both / total * np.log(both * w.sum() / (one * two))
            if info >= TIE:
                edges.append((info, a, b))
    near: dict[int, list[int]] = {k: [] for k in range(m)}
    group = list(range(m))
    for _, a, b in sorted(edges, reverse=True):
        if group[a] != group[b]:
            near[a].append(b)
            near[b].append(a)
            group = [group[a] if g == group[b] else g for g in group]
    parent, seen = [-1] * m, set()
    for root in range(m):
        stack = [root] if root not in seen else []
        seen |= set(stack)
        while stack:
            k = stack.pop()
            for c in near[k]:
                if c not in seen:
                    parent[c] = k
                    seen.add(c)
                    stack.append(c)
    return parent


def fit_label_model(masks: np.ndarray, free: np.ndarray, known: np.ndarray) -> LabelModel:
    """EM over distinct masks: `free` counts of unlabelled rows, `known` [mask, class] of labelled.

    It begins with independent voters, then ties those whose votes go together beyond what the
    class explains, and goes on.
    """
    m = len(VOTERS)
    votes = (masks[:, None] >> np.arange(m)) & 1
    some = votes[:, :LEXICON_VOTERS].any(axis=1)
    guess = np.where(some, 0.9, 0.02) if not known.sum() else None
    parent = [-1] * m
    model = None
    for step in range(EM_ROUNDS):
        if model is None:
            toxic = guess if guess is not None else (known[:, 1] + 0.1 * some) / (known.sum(1) + 0.1 + 1e-9)
        else:
            toxic = model.posterior(votes)
        mass = known + free[:, None] * np.column_stack([1 - toxic, toxic])
        if step == EM_ROUNDS // 3:
            parent = _tied(votes, mass)
        rate = np.zeros((m, 2, 2))
        for j, p in enumerate(parent):
            for g in (0, 1):
                rows = votes[:, p] == g if p >= 0 else np.ones(len(votes), bool)
                fired = mass[rows & (votes[:, j] == 1)].sum(axis=0)
                held = mass[rows].sum(axis=0)
                # the prior says which class is which: lexicon hits are rare in clean texts
                before, size = (LEXICON_PRIOR if j < LEXICON_VOTERS else PATTERN_PRIOR)
                rate[j, g] = (fired + np.multiply(before, size)) / (held + np.array(size))
        rate = np.clip(rate, 1e-4, 1 - 1e-4)
        prior = float((mass[:, 1].sum() + 1) / (mass.sum() + 10))
        model = LabelModel(prior, parent, rate)
    return model


def _inputs(hits: np.ndarray) -> np.ndarray:
    """Classifier inputs: log counts, their rate by length, and a constant."""
    counts, size = hits[:, :-1], hits[:, [-1]]
    return np.column_stack(
        [np.ones(len(hits)), np.log1p(counts), np.minimum(counts, 1.0), np.log1p(counts) / (1 + size), size / 10]
    )


def fit_linear(rows: DataFrame, posterior: dict[int, float]) -> np.ndarray:
    """Logistic regression of rows (hits, mask) on their masks' posteriors by Newton steps.

    Each partition sums its part of gradient and curvature; one small matrix each is moved.
    """
    size = 1 + 3 * len(HITS) + 1
    known = np.zeros(1 << len(VOTERS))
    for k, v in posterior.items():
        known[k] = v
    beta = np.zeros(size)
    for _ in range(NEWTON_ROUNDS):

        def partial(batches, beta=beta):
            total = np.zeros((size, size + 1))
            for batch in batches:
                x = _inputs(np.asarray(batch.column(0).flatten(), float).reshape(-1, len(FEATURES)))
                y = known[np.asarray(batch.column(1))]
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                total += x.T @ np.column_stack([x * (p * (1 - p))[:, None], y - p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size)), pa.array(list(total))], ["line", "sums"]
            )

        def add(pdf):
            return pdf.iloc[:1].assign(sums=[np.sum(np.stack(pdf["sums"].to_list()), axis=0)])

        parts = rows.select("hits", "mask").mapInArrow(partial, "line bigint, sums array<double>")
        got = parts.groupBy("line").applyInPandas(add, "line bigint, sums array<double>").collect()
        if not got:
            return beta
        system = np.array([r["sums"] for r in sorted(got, key=lambda r: r["line"])])
        ridge = PENALTY * np.eye(size)
        ridge[0, 0] = 1e-3  # the constant is free
        step = np.linalg.solve(system[:, :size] + ridge, system[:, size] - ridge @ beta)
        step *= min(1.0, 8.0 / max(np.abs(step).max(), 1e-12))
        beta = beta + step
        if np.abs(step).max() < 1e-3:
            break
    return beta


def score_rows(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, carry: DataFrame
) -> DataFrame:
    """Rows (row, held_out, score); `carry` holds the packed rows with `id` and `text`."""
    known = (
        labels.where(F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lexicon = mine_lexicon(
        texts.where(F.col("text").isNotNull()),
        cut(known.where(id_remainder(F.col("id"), FOLDS) != HELD)),
    )
    rows = cut(
        carry.select(
            "row",
            "id",
            (id_remainder(F.col("id"), FOLDS) == HELD).alias("held_out"),
            count_hits(F.col("text"), lexicon).alias("hits"),
        ).withColumn("mask", vote_mask(F.col("hits")))
    )
    seen = rows.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).collect()
    told = (
        rows.where(~F.col("held_out"))
        .select("id", "mask")
        .join(known, "id")
        .groupBy("mask")
        .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
        .collect()
    )
    if not seen:
        return rows.select("row", "held_out", F.lit(0.0).alias("score"))
    masks = np.array([r["mask"] for r in seen])
    place = {int(k): i for i, k in enumerate(masks)}
    sure = np.zeros((len(masks), 2))
    for r in told:
        sure[place[r["mask"]]] = r["good"], r["bad"]
    free = np.array([float(r["n"]) for r in seen]) - sure.sum(axis=1)
    model = fit_label_model(masks, np.maximum(free, 0), sure)
    votes = (masks[:, None] >> np.arange(len(VOTERS))) & 1
    posterior = dict(zip(masks.tolist(), model.posterior(votes).tolist(), strict=True))
    beta = fit_linear(rows, posterior)

    @F.arrow_udf("double")
    def score(hits: pa.Array) -> pa.Array:
        x = _inputs(np.asarray(hits.flatten(), float).reshape(-1, len(FEATURES)))
        return pa.array(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))

    return rows.select("row", "held_out", score("hits").alias("score"))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: id, `held_out`, `score` and `predicted`.

    Labels are read only where crc32 of the id as text doesn't leave 2 modulo 4. Null and empty
    texts count as texts without a word and are scored; null ids are scored and not learnt from;
    repeated labels of one id count by majority. Without labels the seed list and the patterns
    alone vote. An empty table gives no rows.
    """
    carry = packed(docs.select(id_col), id=F.col(id_col)) if text_col == id_col else docs.select(
        F.struct(F.col(id_col)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    scored = score_rows(docs, labels, label_col, id_col, text_col, carry)
    return scored.select(
        F.col("row").getField(id_col).alias(id_col), "held_out", "score"
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score stays below the threshold."""
    carry = packed(docs, id=F.col(id_col), text=F.col(text_col).cast("string"))
    scored = score_rows(docs, labels, label_col, id_col, text_col, carry)
    return scored.where(F.col("score") < THRESHOLD).select("row.*")


@query()
def op5_toxicity(spark, folder):
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
