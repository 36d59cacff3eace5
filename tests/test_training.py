"""Training-data operators against brute force on small fixtures, with nulls, ties, repeats and empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import bloom, boundary_split, components, format_duplicates, proportional_sample, ranking, word_overlap

SCHEMA = "example_id bigint, instruction string, context string, response string, plan_id string, challenge_type string, split_name string, source string, keys string, h string"


def row(i, ins="do it now please", ctx="", resp="", split="train", ch="a", src="s", plan="p"):
    return (i, ins, ctx, resp, plan, ch, split, src, "clash", "clash")


def pairs(df, a="id", b="member"):
    return sorted((r[a], r[b]) for r in df.collect())


def text(r, n=60):
    return " ".join(f"w{r.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def examples(spark):
    r = random.Random(3)
    rows, i = [], 1
    for k in range(40):
        c, t = text(r), text(r)
        rows.append(row(i, ctx=c, resp=t, split="train"))
        i += 1
        if k % 2 == 0:  # edited, reordered
            w = c.split()
            w[3], w[10] = "new", "words"
            half = len(w) // 2
            rows.append(row(i, ctx=" ".join(w[half:] + w[:half]), resp=t + " tail", split="val" if k % 4 else "test"))
            i += 1
        if k % 5 == 0:  # same but for format
            rows.append(row(i, ctx=c.upper().replace(" ", ",  "), resp=t, split="val"))
            i += 1
        if k % 7 == 0:  # same context, other response and instruction
            rows.append(row(i, ins="summarise the text", ctx=c, resp=text(r), split="val"))
            i += 1
    rows += [row(i, ctx=None, resp="x y"), row(i + 1, ctx="", resp=""), row(i + 2, ctx="a b c", resp=None, split=None), row(None, ctx="a b c", resp="d")]
    rows += [rows[0], rows[1]]  # redelivered
    return rows


def closed(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in root if find(x) != x)


def sim(a, b):
    a, b = (a or "").lower().replace(",", " ").split(), (b or "").lower().replace(",", " ").split()
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b)) if a and b else 0


def test_near_groups_match_brute_force(spark, examples):
    by = {r[0]: r for r in examples if r[0] is not None}
    want = closed([(a, b) for a in by for b in by if a < b and sim(by[a][2], by[b][2]) >= 0.7 and sim(by[a][3], by[b][3]) >= 0.7])
    got = pairs(word_overlap.near_groups(spark.createDataFrame(examples, SCHEMA), "example_id", "context", "response"))
    assert got == want and len(want) > 20


@pytest.mark.parametrize("portion", [8192, 16])
def test_near_groups_in_a_hot_bucket(spark, monkeypatch, portion):
    if portion < 100:  # salted buckets
        monkeypatch.setattr(word_overlap, "PORTION", portion)
        monkeypatch.setattr(word_overlap, "PROBE", 1)
    r = random.Random(5)
    base = [f"q{i}" for i in range(80)]
    rows = []
    for i in range(1, 90):  # small edits of one text, more than a bucket holds at once
        w = list(base)
        w[r.randrange(80)] = f"z{i}"
        rows.append(row(i, ctx=" ".join(w), resp="same answer for all"))
    got = pairs(word_overlap.near_groups(spark.createDataFrame(rows, SCHEMA), "example_id", "context", "response"))
    assert got == [(1, i) for i in range(2, 90)]


def test_cross_split_pairs_match_brute_force(spark, examples):
    by = {r[0]: r for r in examples if r[0] is not None}
    want = sorted({(a, b) for a in by for b in by if by[a][6] == "train" and by[b][6] in ("val", "test") and sim(by[a][2], by[b][2]) >= 0.7 and sim(by[a][1], by[b][1]) >= 0.6})
    df = spark.createDataFrame(examples, SCHEMA)
    found = word_overlap.cross_split_pairs(df)
    assert sorted((r.train_id, r.eval_id) for r in found.collect()) == want and len(want) > 20
    links = word_overlap.cross_split_links(df)
    assert {(r.id, r.links) for r in links.collect()} == set(Counter(x for p in want for x in p).items()) and links.where("class_id > id").count() == 0
    report = word_overlap.overlap_report(links, df).collect()
    assert sum(r.pairs for r in report) == len(want)


def test_overlap_operators_on_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert word_overlap.near_groups(empty, "example_id", "context", "response").count() == 0
    assert word_overlap.cross_split_pairs(empty).count() == 0 and word_overlap.cross_split_links(empty).count() == 0
    counts, members = format_duplicates.collapse(empty)
    assert counts.count() == 0 and members.count() == 0


def test_format_duplicates(spark):
    rows = [
        row(5, "Do IT", "a b", '{"x": "One, two", "y": [1, 2]}'), row(3, "do  it!", "A-B", '{"y":[1,2],"x":"one two"}'), row(9, "doit", "ab", '{"x": "one", "y": "two 1 2"}'),
        row(1, None, None, None), row(2, "", " ", "..."), row(7, "unique", "text", "z"), row(7, "unique", "text", "z"), row(8, "ÉTÉ", "strasse", "r"), row(4, "été", "STRASSE", "R"), row(None, "q", "q", "q"),
        row(11, "{not json", "c", "{not json"), row(10, "not json", "c", "not json"),
    ]
    counts, members = format_duplicates.collapse(spark.createDataFrame(rows, SCHEMA))
    assert pairs(members) == [(1, 2), (3, 5), (4, 8), (10, 11)]
    assert {r.id: r.copies for r in counts.collect()} == {1: 2, 3: 2, 4: 2, 7: 1, 9: 1, 10: 2}


def test_format_duplicates_over_several_ranges_of_hashes(spark, monkeypatch):
    monkeypatch.setattr(bloom, "CAPACITY", 100)
    rows = [row(i, f"text {i % 270}", "a", "b") for i in range(1, 361)]
    counts, members = format_duplicates.collapse(spark.createDataFrame(rows, SCHEMA))
    assert pairs(members) == [(i, i + 270) for i in range(1, 91)]
    assert counts.count() == 270 and counts.where("copies = 2").count() == 90


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {(r.id, r.root) for r in components.components(links).collect()} == {(i, 1) for i in range(1, 61)} | {(100, 100), (101, 100)}


def test_repair_meets_floors_and_lowers_the_deviation():
    available, share, floor = np.array([1000, 30, 5, 0]), np.array([0.25, 0.25, 0.25, 0.25]), np.array([2, 2, 2, 2])
    take = proportional_sample.repair(available, share, floor, 100, 1)
    assert take.sum() == 100 and (take <= available).all() and (take >= np.minimum(floor, available)).all()
    assert take[2] == 5 and take[3] == 0 and np.abs(take - 25).sum() == 90  # the least deviation there is
    huge = proportional_sample.repair(np.array([2_000_000_000, 3_000_000_000]), np.array([0.5, 0.5]), np.array([1, 1]), 2_500_000_000, 1)
    assert huge.tolist() == [1_250_000_000] * 2
    assert proportional_sample.repair(np.zeros(2, int), share[:2], floor[:2], 10, 1).sum() == 0


def test_target_report_and_draw(spark):
    rows = [row(i, ch=" Mixed-Code text\n" if i % 2 else "b", src="s") for i in range(1, 201)] + [row(300, ch=None, plan="p1"), row(301, ch="Introuvable", plan="none"), row(302, ch="b", src=None)]
    plans = spark.createDataFrame([("p1", "c"), (None, "x")], "plan_id string, challenge_type string")
    targets = spark.createDataFrame([("t", "s", "mixed_code_text", 50, 10, 1), ("t", "s", "b", 30, 10, 1), ("t", "s", "c", 20, 10, 1), ("t", "none", "b", 100, 50, 3)], "target_set string, source string, challenge_type string, target_pct int, sample_pct int, min_rows int")
    categorised = proportional_sample.categorised(spark.createDataFrame(rows + rows[:5], SCHEMA), plans)
    report = {(r.source, r.challenge_type): r for r in proportional_sample.target_report(categorised, targets).collect()}
    assert [report["s", c].available for c in ("mixed_code_text", "b", "c")] == [100, 100, 1]
    assert not report["s", "c"].met and report["s", "c"].required == 4 and not report["none", "b"].met and report["s", "b"].met
    got = Counter(r.category for r in proportional_sample.draw(categorised, proportional_sample.target_report(categorised, targets)).collect())
    assert got == {c: report["s", c].allotted for c in ("mixed_code_text", "b", "c")} and sum(got.values()) == 20 and not report["s", "c"].met


LONG = "\n\n".join(". ".join(f"Sentence {i} {j} says something of its own" for j in range(6)) + "." for i in range(40))


@pytest.mark.parametrize("body", [LONG, "x" * 5000, "é́" * 3000, "line\n" * 1500, "| a | b |\n" * 700, "word " * 2000, "a\r\n" * 2000])
def test_pieces_cover_the_text_within_the_limit(body):
    cut = boundary_split.pieces_of(body, 200, 20, 24)
    assert "".join(body[s + o:e] for s, e, o in cut) == body
    assert all(e - s <= 800 for s, e, _ in cut) and all(o == 96 for _, _, o in cut[1:]) and len(cut) > 1


@pytest.mark.parametrize("at", range(2, 38, 5))
def test_an_edit_moves_only_the_pieces_around_it(at):
    cut = lambda t: [t[s + o:e] for s, e, o in boundary_split.pieces_of(t, 200, 20, 24)]
    at = LONG.index(f"Sentence {at} 3")
    a, b = cut(LONG), cut(LONG[:at] + "An inserted sentence. " + LONG[at:])
    same = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    before = same(a, b)
    assert len(a) - before - same(a[before:][::-1], b[before:][::-1]) <= 3


def test_split_oversized(spark):
    limits = spark.createDataFrame([(200, 20, 24)], "max_tokens int, min_tokens int, overlap_tokens int")
    texts = spark.createDataFrame([("a", LONG, 1), ("a", LONG, 1), ("b", "x" * 800, 1), ("c", "x" * 801, 1), ("d", None, 1), ("e", " " * 5000, 1), (None, LONG, 1)], "chunk_id string, text string, piece_no int")
    got = boundary_split.split_oversized(texts, limits, "child").collect()
    assert {r.chunk_id for r in got} == {"a", "c"} and all(len(r.text) <= 800 for r in got)
    assert boundary_split.split_oversized(texts.limit(0), limits, "child").count() == 0
    with pytest.raises(ValueError):
        boundary_split.split_oversized(texts, limits.limit(0), "child")


def test_quotas_positions_and_first_by_key(spark):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else "ab"[i % 2]) for i in range(1, 501)], "id bigint, g string")
    taken = Counter(r.g for r in ranking.within_quota(df, ["g"], ranking.hex_spot("1", F.col("id")), "id", F.floor(F.col("n") * 4 / 5)).where("taken").collect())
    assert taken == {None: 40, "a": 160, "b": 200}
    assert sorted((r.id, r.position) for r in ranking.numbered(df, "id").collect()) == [(i, i - 1) for i in range(1, 501)]
    assert sorted(r.id for r in ranking.first_by_key(df, F.col("g"), F.col("id")).where("first").collect()) == [1, 2, 10]
