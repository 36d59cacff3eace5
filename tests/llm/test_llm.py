"""Language-model data operators on small fixtures: brute force, held-out accuracy, nulls, repeats and empty tables."""

import json
import random

import numpy as np
import pytest

from loam.llm import abuse, answers, leaks, mixing, truncation

WORDS = [f"w{i}" for i in range(500)]


def passage(r, n=60):
    return [r.choice(WORDS) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_leaks(spark, monkeypatch):
    r = random.Random(2)
    items = [(k, passage(r)) for k in range(12)]
    docs, want = [], set()
    for i in range(60):
        body = passage(r, 150)
        if i % 3 == 0:
            k, item = items[i % 12]
            part = list(item[: 30 + i % 30])
            part[5] = "changed"
            body[40:40] = part
            assert lcs(item, part) >= 29
            if lcs(item, part) >= 30:
                want.add((i, k))
        docs.append((i, ",  ".join(body).upper(), "clash"))
    docs += [(100, None, ""), (101, "", ""), (None, " ".join(items[0][1]), ""), docs[0], (102, " ".join(reversed(items[1][1])), "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(k, " ".join(w), "s") for k, w in items], "item_id bigint, text string, suite string")
    got = leaks.leaks(df, it)
    found = {(x.doc_id, x.item_id) for x in got.collect()}
    assert want <= found and all(i % 3 == 0 and i < 60 for i, _ in found)
    assert leaks.leak_report(got, it).count() > 0
    monkeypatch.setattr(leaks, "MAX_ITEMS", 5)  # several passes
    assert {(x.doc_id, x.item_id) for x in leaks.leaks(df, it).collect()} == found
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0


def test_leaks_without_repeated_runs_of_five_words(spark):
    r = random.Random(5)
    items = [(0, passage(r, 60)), (1, passage(r, 10)), (2, passage(r, 10))]
    thinned = [w if i % 5 else "changed" for i, w in enumerate(items[0][1])]
    docs = [passage(r, 50) + x + passage(r, 50) for x in (thinned, items[1][1][2:8], items[2][1][:3] + ["changed"] + items[2][1][4:8], items[0][1][::-1], items[1][1][:2])]
    want = {(0, 0, 0.8), (1, 1, 0.6), (2, 2, 0.7)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    it = spark.createDataFrame([(k, " ".join(w), "s") for k, w in items], "item_id bigint, text string, suite string")
    assert {(x.doc_id, x.item_id, round(x.share, 6)) for x in leaks.leaks(df, it).collect()} == want


def dense(item, window):
    """Most words of the item in order in runs of three, by dynamic programming over all pairs of places."""
    n, m = len(item), len(window)
    run = [[0] * (m + 1) for _ in range(n + 1)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            run[i][j] = run[i - 1][j - 1] + 1 if item[i - 1] == window[j - 1] else 0
            best[i][j] = max([best[i - 1][j], best[i][j - 1], *(best[i - k][j - k] + k for k in range(3, run[i][j] + 1))])
    return best[n][m]


def test_leaks_match_brute_force():
    r, few = random.Random(6), WORDS[:12]
    items = [(k, [r.choice(few) for _ in range(8 + k)]) for k in range(6)]
    p = leaks.Patterns(items)
    docs = []
    for k, item in items * 12:
        body = [r.choice(few if r.random() < 0.4 else WORDS) for _ in range(40)]
        part = [w for w in item if r.random() < 0.9]
        part[r.randrange(len(part))] = "changed"
        body[20:20] = part
        docs.append(body)
    hit = 0
    for words in docs + [a + b for a, b in zip(docs, docs[1:])]:
        room = {k: int(len(item) * leaks.SLACK) + leaks.EDGE for k, item in items}
        want = {k for k, item in items if max(dense(item, words[i:i + room[k]]) for i in range(len(words))) >= 0.5 * len(item)}
        assert {k for k, _ in p.leaked(words, 0.5)} == want
        hit += len(want)
    assert hit > 50


def test_bit_parallel_subsequence_matches_the_table():
    r = random.Random(4)
    item = passage(r, 40)
    p = leaks.Patterns([(1, item)])
    for _ in range(30):
        other = [r.choice(item + WORDS[:20]) for _ in range(50)]
        assert p.common(1, other) == lcs(item, other)


def test_rake_meets_margins_and_limits():
    tokens = np.array([100.0, 50, 80, 20, 10])
    source, lang = np.array([0, 0, 1, 1, 2]), np.array([0, 1, 0, 1, 0])
    w = mixing.rake(tokens, [(source, np.array([60.0, 60, 40])), (lang, np.array([90.0, 70]))], np.array([2.0, 2, 2, 2, 2]))
    got = np.bincount(source, w * tokens)
    assert got[:2] == pytest.approx([60, 60], rel=1e-4) and got[2] == pytest.approx(20) and (w <= 2 + 1e-9).all()


def test_topics_part_documents_by_their_words():
    r = random.Random(2)
    kinds = [[f"{stem}{c}" for c in "abcdefghij"] for stem in ("cloud", "query", "vault", "paint")]
    texts = [("fr" if i % 2 else "en", " ".join(r.choice(kinds[i // 2 % 4]) for _ in range(40))) for i in range(400)]
    model = mixing.Topics(texts)
    got = model.of([g for g, _ in texts], [t for _, t in texts], {})
    by = {}
    for i, name in enumerate(got):
        by.setdefault(name, []).append(i // 2 % 4)
    assert sum(max(x.count(k) for k in range(4)) for x in by.values()) > 0.7 * len(texts) and {n[:2] for n in by} == {"fr", "en"}
    assert model.of(["fr", "xx", "fr"], ["", "clouda", None], {}) == ["none"] * 3 and mixing.Topics([]).of(["fr"], ["a text"], {}) == ["none"]


def test_topics_come_from_all_documents(spark):
    """A language that a sample of 2,000 documents would hardly hold gets its topics, whatever the order of the documents."""
    r = random.Random(3)
    docs = [(i, " ".join(passage(r, 8) + ["alpha", "gamma"][i % 2:][:1] * 4).replace("w", "word"), "en", "s") for i in range(40_000)]
    docs += [(50_000 + i, "palabra fila", "es", "s") for i in range(2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    got = {x.doc_id: (x.topic, x.tokens) for x in mixing.with_tokens(df, vocabulary=None).collect()}
    assert len(got) == 40_002 and {v[0] for k, v in got.items() if k >= 50_000} <= {"es0", "es1"} and not {v[0] for k, v in got.items() if k % 2 and k < 40_000} & {v[0] for k, v in got.items() if k % 2 == 0 and k < 40_000}
    assert got == {x.doc_id: (x.topic, x.tokens) for x in mixing.with_tokens(df.repartition(7, "text"), vocabulary=None).collect()}


def test_mix(spark):
    docs = [(i, "some words of text " * (1 + i % 7), ("fr", "EN", None, "de-DE")[i % 4], "big" if i % 4 else "small", 1) for i in range(800)]
    docs += [(900, None, None, "big", 1), (901, " ", "fr", None, 1), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, tokens int")
    targets = spark.createDataFrame([("m", "big", 60, 2, 50), ("m", "small", 40, 1, 50), ("n", "big", 10, 1, 10), ("n", "gone", 90, 3, 10)], "mix_name string, source string, target_pct int, max_repeats int, budget_pct int")
    tokens = mixing.with_tokens(df, vocabulary=None)
    assert tokens.count() == 801
    weights, report = mixing.plan(tokens, targets)
    drawn = mixing.draw(tokens, weights)
    rows = {(r.mix_name, r.source): r for r in mixing.mix_report(spark, drawn, report).collect()}
    assert rows["m", "big"].reachable and not rows["n", "gone"].reachable and rows["m", "big"].most_copies <= 2
    assert rows["m", "big"].drawn_tokens == pytest.approx(rows["m", "big"].target_tokens, rel=0.12)
    assert mixing.plan(tokens.limit(0), targets)[0] == []


def test_normalised_undoes_disguise():
    assert abuse.normalised("i.d.i.o.t, so I D I O T 1d107 id​iot `code idiot`\n| idiot |") .count("idiot") == 4
    assert abuse.normalised("a``` x ```b 123 é") == ["a", "b", "#", "é"]


def test_no_part_of_a_text_is_lost_to_scoring():
    text = "\n | a | `b` |\n|---|---|\n\n| moron | c |\nyou idiot {{bastard}}\n\n```\ncretin"
    prose, rest = abuse.split(text)
    assert prose == ["you", "idiot"] and rest == ["a", "b", "moron", "c", "bastard", "cretin"]
    assert len(abuse.Encoder()(text)) == len(prose) + len(rest) + 2


def test_scores_match_the_forward_pass():
    net, encode, r = abuse.Network(), abuse.Encoder(), random.Random(3)
    docs = [encode(" ".join(passage(r, 40)) + "\n| x | y |") for _ in range(20)]
    assert net.score(docs) == pytest.approx(1 / (1 + np.exp(-net.forward(abuse._padded(list(map(abuse._ids, docs))))[-1])), abs=1e-6)


def test_abuse_on_held_out_sentences(spark):
    r = random.Random(1)
    plain = [f"the {a} {b} the {c} after the {d}" for a in ("cluster", "queue", "index", "gateway") for b in ("locks", "checks", "moves") for c in ("table", "disk", "token") for d in ("restart", "upgrade", "backup")]
    bad = [f"you are a {a} {b} and nobody {c} you" for a in ("stupid", "filthy", "pathetic") for b in ("moron", "idiot", "loser", "dimwit") for c in ("likes", "wants", "misses")]
    docs, labels = [], []
    for i in range(400):
        abusive = i % 5 == 0
        text = ". ".join(r.sample(plain, 4) + ([r.choice(bad)] if abusive else []))
        docs.append((i, text, "en", "s", 0.5))
        if i % 2 == 0:
            labels.append((i, "x", int(abusive), 1))
    docs += [(1000, None, None, None, 0.0), (1001, " ", "fr", "s", 0.0), docs[0], (None, "x", "en", "s", 0.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, annotator string, abusive int, n int")
    got = {x.doc_id: x for x in abuse.scores(df, lab).collect()}
    assert len(got) == 402 and got[1000].score == 0 and not got[1001].flagged
    odd = [i for i in range(1, 400, 2)]
    assert np.mean([got[i].flagged == (i % 5 == 0) for i in odd]) > 0.97
    assert abuse.scores(df, lab.limit(0)).where("flagged").count() == 0 and abuse.scores(df.limit(0), lab).count() == 0


def test_abuse_behind_and_inside_a_table_is_found(spark):
    plain = [f"the {a} {b} the {c}" for a in ("cluster", "queue", "index", "gateway") for b in ("locks", "checks", "moves") for c in ("table", "disk", "token")]
    bad, r = ["you are a stupid moron", "shut up you filthy idiot"], random.Random(4)
    docs = [(i, ". ".join(r.sample(plain, 3) + [bad[i % 2]] * (i % 5 == 0)), "en", "s") for i in range(200)]
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)], "doc_id bigint, abusive int")
    rows = "| name | value |\n|---|---|\n| disk | 4 |"
    docs += [(300, f"{rows}\n\n{bad[0]}", "en", "s"), (301, f"{rows}\n| x | {bad[1]} |", "en", "s"), (302, f"```\n{bad[0]}", "en", "s"), (303, f"{rows}\n\n{plain[0]}", "en", "s")]
    got = {x.doc_id: x.flagged for x in abuse.scores(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), lab).where("doc_id >= 300").collect()}
    assert got == {300: True, 301: True, 302: True, 303: False}


def test_all_labels_and_documents_teach(spark, monkeypatch):
    plain = [f"the {a} {b} the {c}" for a in ("cluster", "queue", "index", "gateway") for b in ("locks", "checks", "moves") for c in ("table", "disk", "token")]
    bad, r = ["you are a stupid moron", "shut up you filthy idiot", "nobody likes you, pathetic loser"], random.Random(6)
    docs = [(i, ". ".join(r.sample(plain, 2) + [bad[i % 3]] * (i % 10 == 0)), "en", "s") for i in range(9_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string")
    lab = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(8_000)], "doc_id bigint, abusive int")
    monkeypatch.setattr(abuse, "BLOCK", 3_000, raising=False)
    told = abuse.quality(df, lab).collect()
    assert [(x.lang, x.abusive_labels, x.ordinary_labels) for x in told] == [("en", 800, 7_200)] and told[0].recall > 0.97 and told[0].precision > 0.97


def test_packed_words_are_those_of_the_encoder():
    r, encode = random.Random(7), abuse.Encoder()
    texts = ["", " ", "1d10t 1D10T idiooot i d i o t", "| a |", "```\nx-y `b`\n```\n{{c}} #1 é", *("".join(r.choice("ab1é_*@$!.- |`\n") for _ in range(60)) for _ in range(300))]
    assert [encode.packed(t) for t in texts] == [abuse._ids(abuse.Encoder()(t)).astype(np.int16).tobytes() for t in texts]


def test_words_packed_together_are_those_of_each_text():
    r, signs = random.Random(9), "aAbé1 9_-.*@$!|`\n\t{}İΣ½漢𝒳\u200b i d"
    texts = ["", "*", "*a", "@$!", "a.-", "I D I O T a b", "x\n| a b c |\n`d`", *("".join(r.choice(signs) for _ in range(r.randrange(50))) for _ in range(2_000))]
    got = list(abuse.Encoder().packed_all(texts))
    assert got == [abuse._ids(abuse.Encoder()(t)).astype(np.int16).tobytes() for t in texts]
    unspaced = lambda t: abuse.SPACED.sub(lambda m: abuse.re.sub(r"[ .\-_]+", "", m[0]), t).replace("_", " ").lower()
    assert [abuse._lowered(t) for t in texts] == list(map(unspaced, texts)) and sum(abuse.SINGLES.search(t) is not None for t in texts) > 100
    h = np.random.default_rng(2).normal(size=(3, 13, 2))
    assert all((abuse._largest(h[:, :n].copy()) == h[:, :n].max(axis=1)).all() for n in range(1, 14))


def test_labels_of_other_documents_add_none(spark):
    docs = spark.createDataFrame([(i, f"the queue {w} the disk" + (", you stupid moron" if i % 4 == 0 else ""), None, "s") for i, w in enumerate(WORDS[:80])], "doc_id int, text string, lang string, source string")
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)] + [(1 << 40, 1), (None, 1)], "doc_id bigint, abusive int")
    got = abuse.scores(docs, lab)
    assert dict(got.dtypes)["doc_id"] == "int" and sorted(x.doc_id for x in got.collect()) == list(range(80))
    assert [(x.abusive_labels, x.ordinary_labels) for x in abuse.quality(docs, lab).collect()] == [(20, 60)]


def test_steps_follow_the_gradient(monkeypatch):
    """One step without anything left out, against differences of the loss."""

    class Still:
        random = staticmethod(lambda n, kind=float: np.full(n, 0.5, kind))
        shuffle = staticmethod(lambda x: None)

    net, words = abuse.Network(), passage(random.Random(2), 30)
    docs = [abuse._ids(abuse.Encoder()(" ".join(words[4 * i:4 * i + 12]))) for i in range(5)]
    y, weight = np.array([1.0, 0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5, 1])

    exact = abuse.Network()
    exact.E, exact.K, exact.c, exact.v = exact.E.astype(float), [k.astype(float) for k in exact.K], [c.astype(float) for c in exact.c], exact.v.astype(float)

    def loss(name, at, by):
        part = dict(exact.named())[name]
        part[at] += by
        z = exact.forward(abuse._padded(docs))[-1]
        part[at] -= by
        return (weight * (np.log1p(np.exp(z)) - y * z)).mean()

    u = np.unique(docs[3][docs[3] >= 0])
    spots = [("K0", (3, 4)), ("K1", (20, 2)), ("K2", (40, 9)), ("K2", (1, 0)), ("c1", 3), ("v", 7), *(("E", (b, 5)) for b in u[:12])]
    want = [(loss(n, at, 1e-6) - loss(n, at, -1e-6)) / 2e-6 for n, at in spots]
    before = {n: x.copy() for n, x in net.named()}
    state = net.start()
    monkeypatch.setattr(abuse.np.random, "default_rng", lambda seed: Still)
    net.fit(docs, y, weight, 1, state)
    for (n, at), g in zip(spots, want):
        step = (before[n][at] - dict(net.named())[n][at]) * np.sqrt(state[n][at]) / abuse.RATE
        assert step == pytest.approx(g, rel=1e-2, abs=1e-6), (n, at)
    assert sum(abs(g) > 1e-5 for g in want) > 5


def test_a_repeated_id_without_text_hides_no_text(spark):
    docs = [(i, f"the queue {w} the disk" + (", you stupid moron" if i % 4 == 0 else ""), "en", "s") for i, w in enumerate(WORDS[:120])] + [(i, None, "en", "s") for i in range(120)]
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, abusive int")
    told = abuse.quality(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(1), lab).collect()
    got = abuse.scores(spark.createDataFrame(docs[::-1], "doc_id bigint, text string, lang string, source string").coalesce(1), lab).collect()
    assert [(x.abusive_labels, x.ordinary_labels) for x in told] == [(30, 90)] and len(got) == 120 and all(x.flagged == (x.doc_id % 4 == 0) for x in got)


FR, EN = "Le serveur redémarre la file d'attente avec le module du réseau et les jetons sont dans la base.", "The server restarts the queue with the module of the network and the tokens are in the base."
ASK_FR, ASK_EN = "Traduis ce document de l'anglais vers le français.", "Translate the document above from French into English."


def test_refusals_in_other_words_are_found(spark):
    df, _ = table(spark)
    other = ["Regrettably this is a request that I have to turn down.", "Ma politique m'interdit de rédiger ce que vous demandez, je ne le ferai donc pas.", "I am afraid that this is something I cannot and will not do for you.", "Impossible pour moi de donner suite : mes règles ne le permettent pas."]
    rows = [(1000 + i, ASK_FR if i % 2 else ASK_EN, (EN if i % 2 else FR) * 3, t, "s", 1.0) for i, t in enumerate(other)]
    more = df.unionByName(spark.createDataFrame(rows, df.schema))
    got = {r.record_id: r.defect for r in answers.defects(answers.pairs_of(spark, more, None, None)).collect()}
    assert sum(got[str(r[0])] == "refusal" for r in rows) >= 3


def test_ending_payload_and_language():
    assert answers.payload('{"a": "x", "b": "longer"}') == ("longer", True, False)
    assert answers.payload('{"a": "cut of')[2] and answers.payload(None) == ("", False, False)
    assert answers.asked_language(ASK_FR) == "fr" and answers.asked_language(ASK_EN) == "en" and answers.asked_language("Donne une version anglaise") == "en" and answers.asked_language("x") is None
    code, opened = "a.\n\n```bash\nls", answers.ending("| a | b |\n| 1")
    assert answers.ending(code)[0][0] == 1 and answers.ending(code + "\n```")[0][0] == 0 and opened[0][2] == 1 and answers.ending("see `a")[0][1] == 1
    assert answers.shape("Aé 9.\n\t") == "Aa 0.\n " and "5aaaa." in answers.ending(FR)[1] and "1a" in answers.ending(FR[:-9])[1]


def test_profiles_know_the_languages_by_the_answers_asked_for():
    fr, en = answers.WORD.findall(FR.lower()), answers.WORD.findall(EN.lower())
    p = answers.Profiles([("fr", fr)] * 200 + [("en", en)] * 200 + [("es", ["uno"])])
    assert p.langs == ["en", "fr"]
    margin, known, n = p.fit("fr", answers.Counter(fr), answers.Counter())
    assert margin > 2 and known == 1 and n == len([w for w in fr if w.isalpha()])
    assert p.fit("fr", answers.Counter(en), answers.Counter())[0] < -2 and p.fit("fr", answers.Counter(["palabra"] * 9), answers.Counter())[1] == 0
    assert p.fit(None, answers.Counter(fr), answers.Counter()) == p.fit("de", answers.Counter(fr), answers.Counter()) == (0, 1, 0)


def test_all_fields_of_a_json_answer_are_read():
    x = lambda answer, source=EN: answers.features(ASK_FR, source, json.dumps(answer), answers.Profiles())
    for answer in ({"translated_title": "Document", "translated_content": ""}, {"translated_title": "Document", "translated_content": None}, {"title": "Document", "content": []}, {"a": {"b": [" "]}}, {}):
        assert x(answer)[0][0] == 1, answer
    nested = {"result": {"parts": [{"text": FR}]}, "title": "Document"}
    assert x(nested)[0][0] == 0 and set(x(nested)[1]) == set(answers.WORD.findall(f"{FR} Document".lower()))
    assert x({"result": {"translated_content": EN}})[0][9] == 1
    assert x({"translated_content": FR[:-9], "note": "A much longer remark that ends with a full stop, as it should do. " * 3})[2] == answers.ending(FR[:-9])[1]
    assert x({"translated_content": FR, "preserved_elements": ["`a_b` and much that stops in" * 9]})[2] == answers.ending(FR)[1]


def table(spark):
    r = random.Random(3)
    rows = []
    for i in range(300):
        n = r.sample(range(1000), 6)
        fr = " ".join(f"{FR[:-1]} {k}." for k in n)
        en = " ".join(f"{EN[:-1]} {k}." for k in n)
        rows.append((i, ASK_FR, en, fr) if i % 2 else (i, ASK_EN, fr, en))
    broken = {1: (None, "empty"), 2: ("N/A", "empty"), 3: ("Je suis désolé, je ne peux pas traduire ce texte.", "refusal"), 4: ("I'm sorry, I cannot help with that request.", "refusal"), 5: (rows[5][2], "copy"), 6: (rows[6][3][:-20], "truncated"), 7: (rows[9][3][:333] + "�", "truncated"), 8: (rows[11][3], "wrong_language"), 9: (ASK_FR, "copy")}
    rows = [(*x[:3], broken[x[0]][0]) if x[0] in broken else x for x in rows]
    df = spark.createDataFrame([(*x, "s", 1.0) for x in rows] + [(*rows[0], "s", 1.0)], "example_id bigint, instruction string, context string, response string, source string, defect double")
    return df, {str(k): v for k, (_, v) in broken.items()}


def test_defects(spark):
    df, want = table(spark)
    found = answers.defects(answers.pairs_of(spark, df, None, None))
    got = {r.record_id: r.defect for r in found.collect()}
    assert len(got) == 300
    wrong = {k: (want.get(k), v) for k, v in got.items() if v != want.get(k)}
    assert len(wrong) <= 2, wrong
    assert answers.answer_rates(found).count() >= 4
    assert answers.defects(answers.pairs_of(spark, df.limit(0), None, None)).count() == 0


def test_all_answers_teach(spark, monkeypatch):
    """A language that few of many answers are asked for has a profile, and blocks that are trained on apart serve as one."""
    r, rows = random.Random(8), []
    es = "El servidor reinicia la cola con el módulo de la red y las fichas están en la base."
    for i in range(4_000):
        text = lambda x: " ".join(f"{x[:-1]} {k}." for k in r.sample(range(1000), 2))  # noqa: E731, B023
        want = "es" if i % 50 == 0 else "fr" if i % 2 else "en"
        rows.append((i, {"es": "Translate the document above from French into Spanish.", "fr": ASK_FR, "en": ASK_EN}[want], text(EN if want == "fr" else FR), text({"es": es, "fr": FR, "en": EN}[want]), "s", 1.0))
    wrong = {50 * k + 450: text(EN) for k in range(3)}
    rows = [(*x[:3], wrong.get(x[0], x[3]), *x[4:]) for x in rows]
    df = spark.createDataFrame(rows, "example_id bigint, instruction string, context string, response string, source string, defect double")
    monkeypatch.setattr(answers, "BLOCK", 1_000, raising=False)
    got = {int(x.record_id): x.defect for x in answers.defects(answers.pairs_of(spark, df, None, None)).collect()}
    assert {k for k, v in got.items() if v == "wrong_language"} == set(wrong) and sum(v is not None for v in got.values()) <= 8


def test_pairs_taken_together_have_the_features_of_each():
    r = random.Random(11)
    p = answers.Profiles([("fr", answers.WORD.findall(FR.lower()))] * 200 + [("en", answers.WORD.findall(EN.lower()))] * 200)
    mixed = lambda n: " ".join(r.choice((FR + EN + " a1 b_2 ½ ²").split()) for _ in range(n))
    rows = [(r.choice([ASK_FR, ASK_EN, "x"]), r.choice(["", EN, mixed(30)]), r.choice([None, "", "n/a", FR, EN, mixed(25), json.dumps({"title": "a", "text": mixed(9)}), "| a | b |\n| 1"])) for _ in range(300)]
    model = answers.Linear()
    model.profiles = p
    dense, grams, ends = model.made(rows)
    table = np.random.default_rng(1).random((answers.BUCKETS, 5))
    for i, (row, mass) in enumerate(zip(rows, grams.mass(table))):
        x, words, names = answers.features(*row, p)
        assert (dense[i] == x).all()
        src, have = answers.Counter(answers.WORD.findall(row[1].lower())), answers.Counter(words)
        margin, known, n = p.fit(answers.asked_language(row[0]), have, src)
        assert x[10] == pytest.approx((have & src).total() / max(1, len(words))) and x[14] == pytest.approx(min(1, n / 12) * max(-4, min(4, margin)) / 2, abs=1e-6) and x[16] == pytest.approx(min(1, n / 12) * (1 - known), abs=1e-6)
        h = [answers.zlib.crc32(b"#" if not w.isalpha() and any(c.isdigit() for c in w) else w.encode()) for w in words]
        h += [(a * 0x9E3779B1 & 0xFFFFFFFF) ^ b for a, b in zip(h, h[1:])]
        assert mass == pytest.approx(sum((table[v % answers.BUCKETS] for v in h), start=np.zeros(5)) / max(1, len(h)) ** 0.5)
        assert sorted(ends.at[ends.starts[i]:ends.starts[i + 1]]) == sorted({answers.zlib.crc32(v.encode()) % answers.SHAPES for v in names})


def test_words_of_many_texts_at_once_are_those_of_the_pattern():
    r, signs = random.Random(4), "aAbéÉ İΣσß_ ½²9-'\n\t.\ud800𝒳漢 "
    texts = ["", "a", "_", "İΣ", *("".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(300)), f"{FR} {EN}"]
    spoken = answers.Spoken([t.lower() for t in texts])
    numbers, places = spoken.numbers()
    words = [answers.WORD.findall(t.lower()) for t in texts]
    assert [[spoken.word(i) for i in range(a, b)] for a, b in zip(spoken.first, spoken.first[1:])] == words
    assert [spoken.word(places[i]) for i in numbers] == sum(words, []) and len(places) == len({w for of in words for w in of})
    assert answers.Spoken([]).numbers()[0].size == answers.Spoken(["", "."]).numbers()[0].size == 0


def test_pairs_are_taken_together_by_number_and_signs():
    sizes = [1] * 2_500 + [answers.SIGNS] * 3 + [5]
    got = list(answers.together(list(range(len(sizes))), sizes))
    assert sum(got, []) == list(range(len(sizes))) and list(map(len, got)) == [1_000, 1_000, 500, 1, 1, 1, 1]


BASE = "result_id bigint, modele string, prompt string, reponse string"
EVAL = "run_id string, modele string, baseline_test array<struct<id:string, categorie:string, prompt:string, response:string, duree:double>>"


def test_truncation_with_a_hard_limit(spark):
    r = random.Random(6)
    rows = []
    for i in range(240):
        fr = " ".join(f"{FR[:-1]} {k}." for k in r.sample(range(1000), 1 + i % 6))
        rows.append((i, "m" if i % 2 else "k", f"Traduis en français : '{EN}'", fr[:300] if i % 2 else fr[:-1] + " " + "x" * r.randrange(200) + "."))
    rows += [(900, "k", "x", None), rows[0]]
    base = spark.createDataFrame(rows, BASE)
    runs = spark.createDataFrame([("r", "m", [("a", None, f"Traduis en français : '{EN}'", FR[:40], 0.1), ("b", None, "x", None, None)]), ("q", "m", None)], EVAL)
    found = truncation.truncated(base, runs)
    got = {(x.record_kind, x.record_id): x for x in found.collect()}
    cut = {str(x[0]) for x in rows if x[3] and len(x[3]) == 300 and not x[3].rstrip().endswith(".")}
    assert {k for (kind, k), x in got.items() if kind == "baseline" and x.truncated} == cut and len(cut) > 40
    assert not got["eval", "r/b"].truncated and ("eval", "q/a") not in got
    top = {(s.source_name, s.unit): s.length for s in truncation.spikes(answers.pairs_of(spark, None, base, runs)).collect()}
    assert top["m", "chars"] == 300 and not any(k[0] == "k" for k in top)
    assert truncation.rates(found).count() == 3
    assert truncation.truncated(base.limit(0), runs.limit(0)).count() == 0
    assert got["eval", "r/a"].truncated


def test_truncation_learns_from_all_answers(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    for i in range(3_000):
        fr = " ".join(f"{FR[:-1]} {k}." for k in r.sample(range(1000), 1 + i % 3))
        rows.append((i, "m", f"Traduis en français : '{EN}'", fr[:-7] if i % 100 == 7 else fr))
    base, runs = spark.createDataFrame(rows, BASE), spark.createDataFrame([], EVAL)
    whole = answers.Profiles([("fr", answers.WORD.findall(t.lower())) for _, _, _, t in rows])
    monkeypatch.setattr(answers, "BLOCK", 800, raising=False)
    assert answers.trained(answers.pairs_of(spark, None, base, runs)).profiles.log == whole.log
    got = {int(x.record_id) for x in truncation.truncated(base, runs).where("truncated").collect()}
    assert got == set(range(7, 3_000, 100))
