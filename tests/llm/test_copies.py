"""Near duplicates, repeated lines and benchmark matches against brute force."""

import random
import re

import pytest

import corpus_pipeline
from studyspark.llm import linededup, neardup
from studyspark.llm.components import components
from studyspark.llm.decontam import contamination, drop_contaminated
from studyspark.llm.linededup import drop_repeated_lines
from studyspark.llm.neardup import keep_one, near_duplicates

from .conftest import prose, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _classes(texts, words, percent):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}


def _family(seed, copies, edits):
    """Copies of one text, each with its own edits, so similarities lie around the threshold."""
    draw = random.Random(seed)
    base = prose(seed, 150, 5000).split()
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(draw.randrange(edits + 1)):
            w[draw.randrange(len(w))] = f"z{draw.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("words,percent,crowd", [(3, 85, 2000), (5, 80, 2000), (3, 85, 4)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, words, percent, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    texts = _family(1, 60, 8) + _family(2, 30, 6) + [prose(k, 120) for k in range(20)] + ["A b", "a B", "a", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {r["key"]["id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, words, percent).collect()}
    assert got == _classes(texts, words, percent)


def test_near_duplicate_edges(spark, edge, empty):
    assert near_duplicates(edge).count() == edge.count()
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 1, 2, 3, 3, 4, 5, 6, 8, 9, 10]
    assert keep_one(empty).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a int, b int")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def _brute_lines(docs, least):
    lines = [(d, i, x) for d, t in docs for i, x in enumerate(t.split("\n"))]
    place = {(d, i): k for k, (d, i, _) in enumerate(lines)}
    gone = set()
    for p, (d, i, _) in enumerate(lines):
        for q in range(p):
            n = 0
            while (
                p + n < len(lines)
                and lines[p + n][0] == d
                and lines[q + n][0] == lines[q][0]
                and lines[p + n][2] == lines[q + n][2]
            ):
                n += 1
            if sum(len(WORD.findall(lines[p + k][2])) for k in range(n)) >= least:
                gone |= {(d, i + k) for k in range(n)}
    assert all(k in place for k in gone)
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_like_brute_force(spark, seed):
    draw = random.Random(seed)
    kinds = ["", "a", "b b", "c c c", "d d d d d", "e e e e e e e e e e e e"]
    docs = [(d, "\n".join(draw.choice(kinds) for _ in range(draw.randrange(1, 14)))) for d in range(25)]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(4)
    got = {r["row"]["doc_id"]: r["text"] for r in drop_repeated_lines(df, min_words=12).collect()}
    assert got == _brute_lines(docs, 12)


def test_line_edges(spark, edge, empty):
    found = drop_repeated_lines(edge).collect()
    assert len(found) == edge.count()
    assert sum(r["text"] is None for r in found) == 1
    # the text of 6 goes from 7, and stays in both rows of 6
    assert [r["row"]["doc_id"] for r in found if r["n_deleted"]] == [7]
    assert drop_repeated_lines(empty).count() == 0


def test_runs_of_every_document(spark, monkeypatch):
    """Hot and other names give the same deletions, whatever counts as hot."""
    shared = "\n".join(prose(70 + k, 20) for k in range(3))
    texts = [f"{prose(k, 12)}\n{shared}\n{prose(1000 + k // 2, 40)}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {}
    for hot in (1, 20, 10**9):
        monkeypatch.setattr(linededup, "HOT", hot)
        got[hot] = sorted((r["row"]["doc_id"], r["text"]) for r in drop_repeated_lines(df).collect())
    assert got[1] == got[20] == got[10**9]
    want = [t if k == 0 else "\n".join(x for j, x in enumerate(t.split("\n")) if not 0 < j < (5 if k % 2 else 4)) for k, t in enumerate(texts)]
    assert got[20] == list(enumerate(want))


def test_equal_hashes_are_not_equal_runs(spark):
    """Places whose first hashes agree and second ones don't are different runs."""
    rows = spark.createDataFrame(
        [(1, 1, [5], [7], [40]), (2, 2, [5], [8], [40]), (3, 3, [5], [7], [40])],
        "id bigint, th bigint, ranks array<bigint>, seals array<bigint>, words array<bigint>",
    )
    assert [(r["id"], r["lines"]) for r in linededup.repeated_lines(rows, 30).collect()] == [(3, [0])]


ITEM = (
    "Last week Anna bought 12 kg of apples at 3 dollars each and gave Bert half of them, so how many "
    "apples does Anna still have after 5 days if Bert eats 2 of them every single day?"
)


def test_templates(spark, edge, empty):
    other = ITEM.replace("Anna", "Carla").replace("Bert", "Dora").replace("12", "70").replace("3 d", "9 d")
    broken = other.replace("does Carla", "does Emil").replace("if Dora", "if Fred").replace("gave Dora", "gave Gina")
    texts = [
        ITEM,
        prose(1, 50) + ". " + other + " " + prose(2, 30),
        broken,
        ITEM.upper(),
        ITEM[:80] + " " + prose(3, 60),
        prose(4, 200),
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "too short to tell"), (3, None)], "item_id bigint, text string")
    got = {r["key"]["id"]: r for r in contamination(df, items).collect()}
    assert [got[k]["contaminated"] for k in range(8)] == [True, True, False, True, False, False, False, False]
    assert got[0]["share"] == 1.0 and got[0]["item"] == 1 and got[5]["item"] is None
    assert sorted(r[0] for r in drop_contaminated(df, items).collect()) == [2, 4, 5, 6, 7]
    assert drop_contaminated(df, items.limit(0)).count() == 8
    assert contamination(edge, items).count() == edge.count()
    assert drop_contaminated(edge, items).columns == edge.columns
    assert contamination(empty, items).count() == 0


def _shares(spark, texts, item):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r["key"]["id"]: r for r in contamination(df, items).collect()}
    return [(got[k]["contaminated"], got[k]["share"]) for k in range(len(texts))]


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Tom buys 3 more. Tom eats 2. How many apples does Tom have?"
    other = item.replace("Tom", "Ann")
    mixed = "Ann has 5 apples. Bob buys 3 more. Cid eats 2. How many apples does Dan have?"
    got = _shares(spark, [other, "We ask: if " + other + " Say it.", other.replace("5", "8"), mixed], item)
    assert [g[0] for g in got] == [True, True, True, False]
    assert got[0][1] == 1.0


def test_numbers_need_their_fillings(spark):
    item = "take 5 of the red pens and then put 5 of the blue pens beside them"
    got = _shares(spark, [item, item.replace("5", "7"), item.replace("put 5", "put 7")], item)
    assert [g[0] for g in got] == [True, True, False]
    rows = " ".join(str(k * 37) for k in range(20))
    table = " ".join(str(k * 91 + 5) for k in range(400))
    assert _shares(spark, [table, "sum all these " + rows], "sum all these " + rows) == [(False, 0.0), (True, 1.0)]


def test_windows_of_unrelated_places_do_not_add_up(spark):
    words = prose(11, 40, 9000).split()
    parts = [" ".join(words[k : k + 10]) for k in range(0, 36, 6)]
    far = " ".join(f"{part} {prose(50 + k, 300, 9000)}" for k, part in enumerate(parts))
    near = " ".join(words[:20]) + " " + prose(60, 12, 9000) + " " + " ".join(words[20:])
    got = _shares(spark, [far, near], " ".join(words))
    assert [g[0] for g in got] == [False, True]


def test_items_under_five_words(spark):
    got = _shares(spark, ["What is a quark?", "He asked what is a quark and left", "what is a", ""], "What is a quark?")
    assert [g[0] for g in got] == [True, True, False, False]


def test_names_of_other_alphabets(spark):
    item = "Вчера Анна купила 12 яблок по 3 рубля и отдала Борису половину, сколько яблок осталось у Анна?"
    other = item.replace("Анна", "Ольга").replace("Борису", "Юрию").replace("12", "70")
    assert [g[0] for g in _shares(spark, [other, item.replace("яблок", "груш")], item)] == [True, False]


def test_windows_that_all_items_share(spark):
    """Documents and items meet on rare windows, so a common opening joins no further pairs."""
    opening = "what is the number of small round things that are left over when"
    items = [f"{opening} {prose(300 + k, 12, 5000)}" for k in range(300)]
    texts = [f"{prose(900 + k, 30, 5000)} {opening} {prose(2000 + k, 30, 5000)}" for k in range(200)]
    texts += [f"{prose(4000 + k, 30, 5000)} {items[k]} {prose(5000 + k, 30, 5000)}" for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r["key"]["id"]: r for r in contamination(docs, bench).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == set(range(200, 220))
    assert all(got[200 + k]["item"] == k and got[200 + k]["n_items"] == 1 for k in range(20))
    # a lower threshold lists what shares less
    less = {r["key"]["id"]: r for r in contamination(docs, bench, share=0.3).collect()}
    assert all(less[k]["n_items"] == 300 for k in range(200))

def test_matches_are_those_of_all_windows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def grams(t):
        w = [re.sub(r".*\d.*", "#", x) for x in term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))]
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    items = {r["item_id"]: grams(r["text"]) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        own = set(grams(r["text"] or ""))
        want[r["doc_id"]] = any(g and sum(x in own for x in g) >= 0.8 * len(g) for g in items.values())
    got = {r["key"]["id"]: r["contaminated"] for r in contamination(docs, bench).collect()}
    assert got == want


def _table(spark, folder, name, df):
    df.write.parquet(f"{folder}/{name}.parquet")


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    toxic = [f"you {w} " + prose(k, 40, 9000) for k, w in enumerate(["idiot", "moron", "scum", "loser"] * 20)]
    clean = [prose(1000 + k, 60, 9000) for k in range(80)]
    passage = prose(7, 55, 9000)
    shared = [f"{prose(2000 + k, 40, 9000)}\n{passage}\n{prose(3000 + k, 40, 9000)}" for k in range(4)]
    near = _family(5, 4, 2)
    leak = [prose(4000, 30, 9000) + ". " + ITEM + " " + prose(4001, 30, 9000)]
    texts = toxic + clean + shared + near + leak + [None, ""]
    rows = [r[:5] for r in rows_of(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    _table(spark, tmp_path, "documents", docs)
    known = [(i, 1, int(i < len(toxic))) for i in range(len(toxic) + len(clean))]
    _table(spark, tmp_path, "labels", spark.createDataFrame(known, "doc_id bigint, quality int, toxic int"))
    _table(spark, tmp_path, "benchmark", spark.createDataFrame([(1, ITEM)], "item_id bigint, text string"))
    at, folder = docs, str(tmp_path)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        kept[name] = {r["doc_id"]: r for r in at.collect()}
        if name != "mixing":
            assert at.columns == docs.columns
    n = len(toxic)
    everything = set(range(len(texts)))
    assert set(kept["toxicity"]) == everything - set(range(n))
    after = kept["line dedup"]
    base = n + len(clean)
    assert set(after) == set(kept["toxicity"])
    assert passage in after[base]["text"] and not any(passage in after[base + k]["text"] for k in (1, 2, 3))
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in after.values())
    near_ids = set(range(base + 4, base + 8))
    classes = _classes([texts[i] for i in sorted(near_ids)], 5, 80)
    stay = {base + 4 + r for _, r in classes.values()}
    assert set(kept["near dedup"]) == set(after) - near_ids | stay
    leak_id = base + 8
    assert set(kept["decontamination"]) == set(kept["near dedup"]) - {leak_id}
    total = sum(len(WORD.findall(r["text"] or "")) for r in kept["decontamination"].values())
    assert sum(r["taken"] for r in kept["mixing"].values()) == int(1.5 * total)
    again = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert again == kept["mixing"]
