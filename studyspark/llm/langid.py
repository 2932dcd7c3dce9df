"""Language identification with a linear-chain conditional random field over words.

Each word has affix, byte n-gram and whole-word (lexicon) features, hashed to one weight table, and
languages follow each other with learned transitions. Forward-backward gives every word's language
probabilities, so a text that switches language is labelled word by word; a document's language is
the one with the largest sum over its words.

Weights are fitted on a bounded, hash-chosen sample of labelled documents, in shards whose weights
are averaged. Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyspark.llm.base import id_remainder, query, table
from studyspark.llm.wordbytes import Chunk, Spans, chunks, mix
from studyspark.operators.lineage import cut

LEARN_DOCS = 1_000  # documents of each language in the sample, on average
SHARDS = 4
EPOCHS = 4
LEARN_BYTES = 1 << 17  # texts of one step
RATE = 0.3
SHRINK = 1e-4
SPLICE = 0.3  # part of the training chains that switch language
SLOTS = 1 << 16
AFFIXES = (1, 2, 3, 4)
CHAIN = 256  # words; a longer line is several chains
FOLDS, HELD = 4, 2
UNKNOWN = "und"


@dataclass
class Words:
    """The words of a chunk: distinct ones with their features, and chains over all of them."""

    inverse: np.ndarray  # distinct word of each word
    own: np.ndarray  # document of each word
    lettered: np.ndarray
    affix: np.ndarray  # [distinct, features] slots
    gram: np.ndarray  # slots of all byte trigrams of the distinct words
    gram_of: np.ndarray  # their distinct word
    gram_share: np.ndarray
    chain: np.ndarray  # first word of each chain
    length: np.ndarray


def read_words(chunk: Chunk) -> Words:
    start, end, own = chunk.terms()
    low = chunk.lowered()
    spans = Spans(low)
    distinct, first, inverse = np.unique(spans.hash(start, end), return_index=True, return_inverse=True)
    s, e = start[first], end[first]
    slot = lambda h, kind: (mix(h + np.uint64(kind)) >> np.uint64(48)).astype(np.int64)
    columns = [slot(distinct, 1), np.zeros(len(distinct), np.int64)]
    for k in AFFIXES:
        columns.append(slot(spans.hash(s, np.minimum(s + k, e)), 10 + k))
        columns.append(slot(spans.hash(np.maximum(e - k, s), e), 20 + k))
    count = np.maximum(e - s - 2, 0)
    gram_of = np.repeat(np.arange(len(distinct)), count)
    at = np.repeat(s, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    gram = slot(spans.hash(at, at + 3), 3)
    share = 1 / np.sqrt(np.maximum(count, 1))
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    letters = np.concatenate([[0], np.cumsum(letter)])
    # a chain ends with its line and after CHAIN words
    breaks = np.concatenate([[0], np.cumsum(chunk.data == 0x0A)])
    line = breaks[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (line[1:] != line[:-1]) | (own[1:] != own[:-1])
    heads = np.flatnonzero(fresh)
    within = np.arange(len(start)) - np.repeat(heads, np.diff(np.append(heads, len(start))))
    chain = np.flatnonzero(within % CHAIN == 0)
    return Words(
        inverse,
        own,
        letters[end] > letters[start],
        np.column_stack(columns),
        gram,
        gram_of,
        share[gram_of],
        chain,
        np.diff(np.append(chain, len(start))),
    )


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    """[distinct, language] sums of the weights of each word's features."""
    out = weights[words.affix].sum(axis=1)
    for k in range(weights.shape[1]):
        out[:, k] += np.bincount(
            words.gram_of, weights=weights[words.gram, k] * words.gram_share, minlength=len(out)
        )
    return out


def forward_backward(
    score: np.ndarray, step: np.ndarray, first: np.ndarray, length: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of each word's languages, expected transitions summed over all chains).

    score: [word, language]; chain c is the words first[c] to first[c] + length[c] - 1.
    """
    e = np.exp(score - score.max(axis=1, keepdims=True))
    move = np.exp(step)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    alpha = np.empty_like(e)
    for t, n in enumerate(active):
        at = first[:n] + t
        a = e[at] if t == 0 else (alpha[at - 1] @ move) * e[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones_like(e)
    expected = np.zeros_like(move)
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        ahead = e[at] * beta[at]
        back = ahead @ move.T
        joint = alpha[at - 1]
        total = (joint * back).sum(axis=1, keepdims=True)
        expected += (joint / total).T @ ahead * move
        beta[at - 1] = back / back.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), expected


def _spliced(words: Words, label: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word places, first, length) of training chains, some of them of two languages."""
    n = len(words.chain)
    partner = draw.permutation(n)
    mixed = (draw.random(n) < SPLICE) & (label[words.chain] != label[words.chain[partner]])
    parts, size = [], []
    for c in range(n):
        a, m = words.chain[c], words.length[c]
        if mixed[c]:
            b, k = words.chain[partner[c]], words.length[partner[c]]
            parts += [np.arange(a, a + (m + 1) // 2), np.arange(b, b + (k + 1) // 2)]
            size.append((m + 1) // 2 + (k + 1) // 2)
        else:
            parts.append(np.arange(a, a + m))
            size.append(m)
    size = np.array(size, np.int64)
    return np.concatenate(parts), np.cumsum(size) - size, size


def train(texts: pa.Array, labels: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by stochastic gradient steps on the chains' conditional likelihood."""
    weights, step = np.zeros((SLOTS, k)), np.zeros((k, k))
    seen_w, seen_s = np.full((SLOTS, k), 1e-6), np.full((k, k), 1e-6)
    draw = np.random.default_rng(seed)
    batches = []
    for chunk in chunks(texts, LEARN_BYTES):
        words = read_words(chunk)
        if len(words.own):
            batches.append((words, labels[chunk.first : chunk.first + chunk.n][words.own]))
    for _ in range(EPOCHS):
        for b in draw.permutation(len(batches)):
            words, label = batches[b]
            place, first, length = _spliced(words, label, draw)
            each = words.inverse[place]
            p, expected = forward_backward(emissions(words, weights)[each], step, first, length)
            p[np.arange(len(place)), label[place]] -= 1
            up = np.empty((len(words.affix), k))
            for j in range(k):
                up[:, j] = np.bincount(each, weights=p[:, j], minlength=len(up))
            grad = np.empty_like(weights)
            flat = words.affix.ravel()
            for j in range(k):
                grad[:, j] = np.bincount(
                    flat, weights=np.repeat(up[:, j], words.affix.shape[1]), minlength=SLOTS
                ) + np.bincount(
                    words.gram, weights=up[words.gram_of, j] * words.gram_share, minlength=SLOTS
                )
            grad = grad / len(place) + SHRINK * weights
            inner = np.ones(len(place), bool)
            inner[first] = False
            now = np.flatnonzero(inner)
            seen = np.zeros((k, k))
            np.add.at(seen, (label[place[now - 1]], label[place[now]]), 1)
            turn = (expected - seen) / len(place) + SHRINK * step
            seen_w += grad**2
            seen_s += turn**2
            weights -= RATE * grad / np.sqrt(seen_w)
            step -= RATE * turn / np.sqrt(seen_s)
    return weights, step


@dataclass(frozen=True)
class LanguageModel:
    """A weight table of fixed size, whatever the corpus."""

    languages: list[str]
    weights: np.ndarray
    step: np.ndarray

    def documents(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """([document, language] sums over lettered words, their number, changes of language)."""
        words = read_words(chunk)
        k = len(self.languages)
        if not len(words.own):
            none = np.zeros(chunk.n, np.int64)
            return np.zeros((chunk.n, k)), none, none
        score = emissions(words, self.weights)[words.inverse]
        p, _ = forward_backward(score, self.step, words.chain, words.length)
        own = words.own[words.lettered]
        p = p[words.lettered]
        sums = np.column_stack([np.bincount(own, weights=p[:, j], minlength=chunk.n) for j in range(k)])
        best = p.argmax(axis=1)
        turn = np.flatnonzero((best[1:] != best[:-1]) & (own[1:] == own[:-1]))
        return sums, np.bincount(own, minlength=chunk.n), np.bincount(own[turn], minlength=chunk.n)


def fit_languages(known: DataFrame) -> LanguageModel:
    """Fit on rows (id, text, lang): about `LEARN_DOCS` hash-chosen documents of each language."""
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0)))
    k = len(names)
    draw = F.pmod(F.xxhash64("id", "lang", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")) - 1
    chance = F.get(F.array(*[F.lit(LEARN_DOCS / sizes[n]) for n in names]), place.cast("int"))
    sample = known.where(draw < chance).select(
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SHARDS)).alias("shard"), "text", place.alias("label")
    )

    def fit(key, rows):
        rows = rows.combine_chunks().sort_by([("label", "ascending"), ("text", "ascending")])
        # languages alternate, so that each step sees all of them
        order = np.random.default_rng(1).permutation(rows.num_rows)
        rows = rows.take(pa.array(order)).combine_chunks()
        texts = rows.column("text").chunk(0) if rows.num_rows else pa.array([], pa.string())
        weights, step = train(texts, np.asarray(rows.column("label")), k, int(key[0].as_py()))
        every = np.concatenate([weights, step])
        used = np.flatnonzero(np.abs(every).sum(axis=1) > 0)
        return pa.table({"slot": pa.array(used), "w": pa.array(list(every[used]), pa.list_(pa.float64()))})

    parts = sample.groupBy("shard").applyInArrow(fit, "slot bigint, w array<double>")
    shards = cut(parts)
    summed = shards.groupBy("slot").agg(
        F.array(*[F.sum(F.col("w")[j]) for j in range(k)]).alias("w")
    )
    every = np.zeros((SLOTS + k, k))
    for r in summed.collect():
        every[r["slot"]] = r["w"]
    # shards hold all languages, so each has met its share of every slot
    every /= SHARDS
    return LanguageModel(names, every[:SLOTS].astype(np.float32), every[SLOTS:])


def label_text(model: LanguageModel, text: str) -> list[tuple[str, str, float]]:
    """(word, language, probability) of each word of one text."""
    out = []
    for chunk in chunks(pa.array([text])):
        start, end, _ = chunk.terms()
        words = read_words(chunk)
        if len(start):
            score = emissions(words, model.weights)[words.inverse]
            p, _ = forward_backward(score, model.step, words.chain, words.length)
            raw = chunk.data.tobytes()
            for s, e, row in zip(start, end, p, strict=True):
                out.append((raw[s:e].decode(), model.languages[row.argmax()], float(row.max())))
    return out


def predict_languages(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score, n_words, n_switches) of each whole text; UNKNOWN without words."""
    names = np.array([*model.languages, UNKNOWN], dtype=object)

    @F.pandas_udf("lang string, score double, n_words bigint, n_switches bigint")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for chunk in chunks(pa.Array.from_pandas(texts, type=pa.string())):
            if model.languages:
                sums, count, turns = model.documents(chunk)
                best = np.where(count > 0, sums.argmax(axis=1), len(model.languages))
                score = sums.max(axis=1) / np.maximum(sums.sum(axis=1), 1e-12)
            else:
                best = score = count = turns = np.zeros(chunk.n, np.int64)
            parts.append(
                pd.DataFrame(
                    {
                        "lang": names[best],
                        "score": np.clip(score, 0, 1).astype(float),
                        "n_words": count,
                        "n_switches": turns,
                    }
                )
            )
        return pd.concat(parts, ignore_index=True)

    return predict(text.cast("string"))


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per document: id, `held_out`, `lang_pred`, `score`, `n_words`, `n_switches`.

    Languages are learnt where `lang_col` isn't null and crc32 of the id as text doesn't leave 2
    modulo 4. Null texts and texts without a letter are `und` with score 0; so is everything if no
    label can be learnt from. Ids may be null or repeat.
    """
    text = F.col(text_col).cast("string")
    held = id_remainder(F.col(id_col), FOLDS) == HELD
    known = docs.where(~held & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).alias("lang")
    )
    model = fit_languages(known)
    rows = docs.select(
        F.col(id_col).alias("id"),
        held.alias("held_out"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        predict_languages(text, model).alias("got"),
    )
    return rows.select(
        F.col("id").alias(id_col),
        "held_out",
        F.when(F.col("lettered"), F.col("got.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("got.score")).otherwise(0.0).alias("score"),
        "got.n_words",
        "got.n_switches",
    )


@query()
def op9_language_id(spark, folder):
    return identify_languages(table(spark, folder, "documents"))
