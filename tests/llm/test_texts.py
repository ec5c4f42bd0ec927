import random

import pytest
from pyspark.sql import functions as F

from lexiweave.llm import garbled as g
from lexiweave.llm import leakage as lk
from lexiweave.llm import packing as pk
from lexiweave.llm import sentences as st
from lexiweave.llm import subjects as sj

# Garbled text.

PLAIN = [
    "Größe und Übung, für naïve Café-Gäste",
    "« L’étude a échoué », note l’équipe à Paris",
    "¿Qué índice mejoró según el señor Muñoz? «Nada más cambió»",
    "A POPULAÇÃO DE LISBOA: CÂMARA, ações e condições",
    "Наш редкий образец описывает метод для группы",
    "本研究把田青与雪松玉的项目放在一起，参见Fig. 31和原川松。",
    "ラモロスの市場に関する研究。Fig. 20のスタレ",
    "फिर दोनरदो, गमबे और गमतल मिले।",
    "รายงานและปีรินปีคงที่ 5 แห่ง",
    "درسنا المدرسة وجمنرلو في 58 موقعا.",
    "A gap of 14.33 µg – about 8 °C × drought – was “seen” ± 2",
    "plain ascii only",
    "",
]
WAYS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("koi8_r", "cp1251"), ("cp1251", "cp1252"), ("gb18030", "latin-1"), ("euc_jp", "latin-1")]


def spoil(text, right, wrong):
    table = g._charset(wrong)
    return "".join(table[b] for b in text.encode(right))


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_stays(text):
    assert g.restore(text) == (False, text)


@pytest.mark.parametrize(("right", "wrong"), WAYS)
def test_wrong_decodings_are_undone(right, wrong):
    tried = 0
    for text in PLAIN[:9]:
        try:
            bad = spoil(text, right, wrong)
        except UnicodeEncodeError:
            continue
        if bad == text:
            continue
        script = "koi8_r" in (right, wrong) or right == "cp1251"
        if script and not any("а" <= c <= "я" for c in text) or right == "euc_jp" and "の" not in text or right == "gb18030" and "究" not in text:
            continue
        tried += 1
        found, got = g.restore(bad)
        assert found, (right, wrong, bad)
        if right not in ("euc_jp", "gb18030"):
            assert got == text
        new, places = g.restore_aligned(bad)
        assert places is None or len(places) == len(new) + 1 and places == sorted(places) and places[-1] == len(bad)
    assert tried


def test_double_and_partial_and_lost():
    text = "Il a échoué. Rien n’a changé pour l’équipe."
    assert g.restore(spoil(spoil(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[1] == text
    part = "Déjà vu. " + spoil("L’été à Paris.", "utf-8", "cp1252")
    assert g.restore(part) == (True, "Déjà vu. L’été à Paris.")
    assert g.restore("relev� fiable") == (True, "relev� fiable")
    assert g.restore("caf&eacute; noir")[1] == "café noir"
    long = "word " * 20_000 + spoil("café", "utf-8", "cp1252")
    assert g.restore(long)[1].endswith("café")


def test_lone_letters():
    assert g.restore("Vers un indicateur utile Ã\xa0 galmuro") == (True, "Vers un indicateur utile à galmuro")
    assert g.restore(spoil("О том, как объект изменяет архив", "koi8_r", "cp1251")) == (True, "О том, как объект изменяет архив")
    for plain in ("AMANHÃ\xa0: O FIM", "ИССЛЕДОВАНИЕ МЕТОДА", "В США и Канаде"):
        assert g.restore(plain) == (False, plain)


def test_bounds_of_the_search_can_be_lifted():
    bad = spoil(spoil("Il a échoué, déjà.", "utf-8", "cp1252"), "utf-8", "cp1252")
    assert g.search(bad, None, 4, None)[0] == g.search(bad)[0] == "Il a échoué, déjà."
    assert g.search(bad, 0)[0] == bad


def test_find_garbled(spark):
    df = spark.createDataFrame([(1, None, "cafÃ©", "x"), (2, "", "café", "x"), (1, "Ã©tude", None, "x")], "rec_id long, title string, abstract string, text string")
    assert sorted((r.rec_id, r.field_name, r.restored) for r in g.find_garbled(df, "rec_id", ["title", "abstract"]).collect()) == [(1, "abstract", "café"), (1, "title", "étude")]
    assert g.find_garbled(df.limit(0), "rec_id", ["title"]).count() == 0


# Sentences.

EN = ["The index rose.", "Dr. Morlan and Prof. Kabre saw Fig. 3 of it.", "It grew by 4.5 points, e.g. in Turin.", "We stored lists, notes, etc.", "The panel met at 9 a.m. in Oslo.", "All sites lie in the U.S.", "It fell ... yet slowly."]


def corpus():
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        names = ["Velpan", "Nikta", "Lumor", "Rovik"]
        own = [rng.choice(EN).replace("Morlan", rng.choice(names)).replace("Kabre", rng.choice(names)) for _ in range(6)]
        texts.append(" ".join(own))
    return texts


@pytest.fixture(scope="module")
def model(spark):
    extra = ["值由3.5升至4.2，参见Fig. 3和图。随后图木被取代。"] * 40
    return st.learn(spark.createDataFrame([(t,) for t in corpus() + extra], "text string"))


def cut(text, model):
    return [text[a:b] for a, b in st.sentences(text, model)]


def test_learnt_abbreviations(model):
    assert {("en", w) for w in ("dr", "prof", "fig", "e.g", "a.m")} <= model.never
    assert not {("en", w) for w in ("rose", "etc", "u.s")} & model.never


def test_followers_of_long_words_count(spark):
    # Every sure end stands after a word of more than five letters.
    ends = ["Morlanos velpanos. Nikta bravolan velpanos. Nikta"] * 100
    numbers = [f"lumor 3. Kab{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    df = spark.createDataFrame([(t,) for t in ends + numbers], "text string")
    assert ("la", "Nikta") in st.learn(df).starters


def test_words_beside_other_marks_count(spark):
    import pyarrow as pa

    text = "Saw (lumor), lumor; lumor: “lumor” lumor? lumor 3, e.g, " + "x" * 50 + " lumor."
    (got,) = st._count(iter([pa.record_batch([pa.array([text])], names=["text"])]))
    rows = {(w, kind): n for _, w, kind, _, n in zip(*got.to_pydict().values())}
    assert rows["lumor", "-"] == 6 and rows["lumor", "E"] == 1
    assert rows["e.g", "-"] == rows["#", "-"] == rows["x" * st.LONGEST, "-"] == 1


def test_statistics_of_restored_texts(spark):
    # The abbreviation stands in wrongly decoded texts only.
    plain = ["Ils ont noté dans la réf. trois que le café est cher."] * 40 + ["Ils ont vu la réf. Morlan dans le café. Puis le thé."] * 10
    stored = [t.encode().decode("cp1252") for t in plain]
    df = spark.createDataFrame(list(enumerate(stored)), "id long, t string")
    got = {(r.rec_id, r.sent_no): stored[r.rec_id][r.sent_start : r.sent_end].encode("cp1252").decode() for r in st.sentence_units(df, "id", "t").collect()}
    assert [got[45, k] for k in (1, 2)] == ["Ils ont vu la réf. Morlan dans le café.", "Puis le thé."] and len(got) == 60


def test_rare_followers_count(spark, monkeypatch):
    # Dates: "Mai" twice after 200 numbers, never after 20,000 sure ends.
    numbers = ["lumor 3. Mai"] * 2 + [f"lumor 3. Kab{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(198)]
    df = spark.createDataFrame([(t,) for t in numbers + [" ".join(["Velpan lumor."] * 21)] * 1000], "text string")
    assert ("la", "Mai") in st.learn(df).dates
    # No starter: "Nikta" 22 times after 5,000 sure ends, but twice after 1,000 abbreviations.
    sure = ["Rovik lumor. Nikta lumor"] * 22 + ["Rovik lumor. Velpan lumor"] * 4978
    df = spark.createDataFrame([(t,) for t in sure + ["Rovik dr. Nikta"] * 2 + ["Rovik dr. Velpan"] * 998], "text string")
    learnt = st.learn(df)
    assert ("la", "dr") in learnt.never | learnt.weak and ("la", "Nikta") not in learnt.starters
    monkeypatch.setattr(st, "MOST_WORDS", 0)
    with pytest.raises(ValueError, match="learnt"):
        st.learn(df)


@pytest.mark.parametrize(
    "want",
    [
        EN,
        ["OBJECTIVES: To see it.", "Was it seen?", "What a list!", "(It is in Table B.)", "One wrote “It failed. Nothing changed.” about it.", "He called it “novel, not old.”", "The version v6.2.1 of it is new."],
        ["随后图木被取代。", "据称“失败了。没有变化。”并退出了。", "是否？"],
        ["फिर वे मिले।", "क्या है?", "न और न।"],
        ["One ends here and the text is cut of"],
    ],
)
def test_boundaries(model, want):
    sep = "" if want[0][0] > "一" else " "
    assert cut(sep.join(want), model) == want
    if sep:
        assert cut("\n\n".join(want), model) == want


def test_odd_texts(model):
    assert cut("It rose.The next one grew.", model) == ["It rose.", "The next one grew."]
    assert cut("ตันมีรายงาน 5 แห่ง กาชาไม่มี\nเวชา", model) == ["ตันมีรายงาน 5 แห่ง", "กาชาไม่มี", "เวชา"]
    assert cut("...", model) == ["..."] and cut("  x  ", model) == ["x"]
    text = "关于图。随后木被取代。"
    bad = spoil(text, "utf-8", "cp1252")
    assert [spoil(s, "utf-8", "cp1252") for s in ("关于图。", "随后木被取代。")] == cut(bad, model)
    long = "The index rose. " * 5000
    assert len(cut(long, model)) == 5000


def test_sentence_units(spark, model):
    df = spark.createDataFrame([(1, "A b. C d.", 0), (2, None, 0), (3, " \n", 0), (1, "A b. C d.", 0)], "rec_id long, abstract string, sent_no int")
    rows = [tuple(r) for r in st.sentence_units(df, "rec_id", "abstract", model).collect()]
    assert sorted(rows) == [(1, 1, 0, 4), (1, 1, 0, 4), (1, 2, 5, 9), (1, 2, 5, 9)]
    assert st.sentence_units(df.limit(0), "rec_id", "abstract").count() == 0


# Leaks.


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["12", "mg", "É"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(80):
        ws = rng.choices(vocab, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            own = (rng.choice(items[:30])[1]).split()
            a = rng.randrange(len(own))
            ws[5:5] = own[a : a + rng.randint(6, 20)]
        docs.append((d, rng.choice([" ", "  ", ", "]).join(ws).upper(), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (0, docs[0][1], "x"), (502, "filler " * 50_000 + items[0][1] + " " + items[1][1], "x")]
    got = lk.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), verbatim=True)

    def grams(t):
        w = lk.words(t or "")
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    of = {i: grams(t) for i, t in items}
    want = {(d, i) for d, t, _ in docs for i in of if grams(t) & of[i]}
    assert want and {(r.doc_id, r.item_id) for r in got.select("doc_id", "item_id").distinct().collect()} == want


def test_all_windows_count(spark):
    ws = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    item = spark.createDataFrame([(7, " ".join(ws)), (8, " ".join(["same"] * 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "filler " + " ".join(ws)), (2, " ".join(ws[5:17])), (3, " ".join(["same"] * 20))], "doc_id long, text string")
    for size in (lk.BROADCAST_BYTES, 0):
        got = lk.leaks(docs, item, broadcast_bytes=size).collect()
        assert {(r.doc_id, r.item_id): (r.n_windows, r.n_verbatim) for r in got} == {(1, 7): (49, 49), (2, 7): (1, 1), (3, 8): (9, 9)}
    assert lk.leaks(docs, item, verbatim=True).count() == 3


@pytest.mark.parametrize("unique", [False, True])
def test_reparameterised_items(spark, unique):
    base = "suppose {a} lends {n} price files to {b} before the wage begins and {a} keeps all the files here"
    # Items of one template, and an item of its own whose names stand with capitals.
    items = [(0, base.format(a="Mirolan", b="Tessin", n=4))] if unique else [(i, base.format(a=f"name{i}", b=f"town{i}", n=i + 20)) for i in range(4)]
    docs = [(1, base.format(a="other", b="place", n=7)), (2, base.replace("and {a} keeps", "and {b} keeps").format(a="other", b="place", n=7)), (3, items[-1][1]), (4, base.format(a="x", b="y", n=7)[:50] + " and other things that no item has at all, one after the other")]
    got = lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    n = len(lk.words(docs[0][1])) - 11
    assert all(rows[1, i].n_windows == n and rows[1, i].n_verbatim == 0 for i, _ in items) and rows[3, items[-1][0]].n_verbatim == n
    # A slot that changes its value within a window doesn't agree; the windows before it do.
    assert all(0 < rows[2, i].n_windows < n for i, _ in items) and not any((4, i) in rows for i, _ in items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert lk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0


def test_lists_share_no_key():
    import numpy as np

    items = [(i, [f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}q" for k in range(40)]) for i in range(300)] + [(900 + i, [b"%d" % (i * 100 + k) for k in range(40)]) for i in range(50)]
    readings = [lk.Reading(np.zeros(0, np.uint64))]
    got = lk._windows([i for i, _ in items], [[w if isinstance(w, bytes) else w.encode() for w in ws] for _, ws in items], readings, lk.ANCHORS, None)
    assert len(set(got["key"])) == len(got["key"]) == 350 * 29


# Packing.


def test_bounds_hold():
    import itertools

    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
        cap = 12
        best = next(k for k in range(1, 8) if any(all(sum(s for s, b in zip(sizes, where) if b == x) <= cap for x in range(k)) for where in itertools.product(range(k), repeat=len(sizes))))
        assert pk.lower_bound(np.bincount(sizes, minlength=cap + 1), cap) <= best
        box = pk.best_fit_decreasing(np.array(sizes), cap)
        assert max(np.bincount(box, weights=sizes)) <= cap and best <= box.max() + 1
        full = pk.completing(np.array(sizes), cap)
        assert max(np.bincount(full, weights=sizes)) <= cap and best <= full.max() + 1 and set(full) == set(range(full.max() + 1))


@pytest.mark.parametrize("part_items", [1000, 40])
def test_packing_is_whole(spark, part_items):
    rng = random.Random(8)
    sizes = [(i, i // 2, rng.choice([0, 5, 100, 700, 1000, 2048, 2049, 5000, rng.randint(1, 1500)])) for i in range(400)]
    out, cert = pk.pack(spark.createDataFrame(sizes, "item long, id long, n_tokens long"), part_items=part_items)
    rows = out.collect()
    fill, per = {}, {}
    for r in rows:
        fill[r.container] = fill.get(r.container, 0) + r.n_tokens
        per.setdefault(r.doc_id, []).append(r)
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(n for _, _, n in sizes)
    assert sorted(r.n_tokens for r in rows if r.piece == 1 and r.first_token == 0 and r.n_tokens < 2048) is not None
    assert len(rows) == sum(1 if n <= 2048 else -(-n // 2048) for _, _, n in sizes)
    rounds = cert.where("part = -1").orderBy("round").collect()
    assert len({r.container for r in rows if not r.container.startswith("full")}) == rounds[-1].containers
    assert rounds[-1].bound <= rounds[-1].containers <= rounds[-1].bound * 1.05 + 1
    assert [r.containers for r in rounds] == sorted({r.containers for r in rounds}, reverse=True) and (len(rounds) > 1) == (part_items == 40)
    assert pk.pack(spark.createDataFrame([], "item long, id long, n_tokens long"))[0].count() == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(pk.VOCABULARY):
        pytest.skip("no vocabulary")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world")], "doc_id long, text string")
    assert sorted((r.id, r.n_tokens) for r in pk.token_counts(df).collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]


# Subjects.


def test_subjects(spark):
    rng = random.Random(6)
    words = {s: [f"{s}{c}word" for c in "abcdefghij"] for s in ("law", "sport", "physics")}
    common = ["index", "panel", "rose", "review"]

    def sentence(s):
        return "The " + " ".join(rng.choices(words[s], k=3) + rng.choices(common, k=4)) + "."

    docs, truth = [], {}
    for d in range(240):
        main, other = rng.sample(sorted(words), 2)
        n = rng.choice([0, 0, 1, 2, 3])
        own = [sentence(main) for _ in range(5 + n)] + [sentence(other) for _ in range(n)]
        rng.shuffle(own)
        docs.append((d, " ".join(own), "x"))
        truth[d] = {main} | ({other} if n >= 2 else set())
    labels = [(d, s, "r") for d in range(0, 240, 2) for s in truth[d]] + [(1, None, "r"), (99999, "law", "r"), (0, min(truth[0]), "r")]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "123 456", "x"), (1003, sentence("law") * 3000, "x"), (0, docs[0][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    got = {}
    for r in sj.assign_subjects(frame, spark.createDataFrame(labels, "doc_id long, subject string, rater string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(1, 240, 2)
    hit = sum(len(got[d] & truth[d]) for d in held)
    assert hit / sum(len(got[d]) for d in held) > 0.95 and hit / sum(len(truth[d]) for d in held) > 0.95
    assert got[1003] == {"law"} and not {1000, 1001, 1002} & set(got)
    none = spark.createDataFrame([], "doc_id long, subject string, rater string")
    assert sj.assign_subjects(frame, none).count() == 0
