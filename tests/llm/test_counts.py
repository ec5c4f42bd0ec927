import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexiweave.llm import cooccurrence as co
from lexiweave.llm import term_frequency as tf
from lexiweave.llm.queries import TERM_BYTES, focus_baskets
from lexiweave.llm.words import LETTERS


def test_term_counts(spark):
    texts = ["Ab abc ABC, abc-def", "", None, "   ", "дом Größe größe ÷ abc", "x" * 50_000 + " abc", "abc"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, title string, term string")
    counts = {r.term: (r.n_occurrences, r.n_records) for r in tf.text_term_counts(df, "title").collect()}
    want, rec = Counter(), Counter()
    for t in texts:
        ws = re.findall(f"[{LETTERS}]{{3,}}", (t or "").lower())
        want.update(ws)
        rec.update(set(ws))
    assert counts == {w: (n, rec[w]) for w, n in want.items()}
    records = tf.record_counts(df, ["title"])
    assert tuple(records.first()) == ("title", 4)
    marks = {r.term: r.mark for r in tf.mark(tf.text_term_counts(df, "title"), records).collect()}
    assert marks["größe"] == "rare" and marks["abc"] == "common"
    empty = df.limit(0)
    assert tf.mark(tf.text_term_counts(empty, "title"), tf.record_counts(empty, ["title"])).count() == 0


def test_value_counts(spark):
    df = spark.createDataFrame([(5,), (5,), (None,), (7,)], "v long")
    assert {(r.term, r.n_records) for r in tf.value_counts(df, "v").collect()} == {("5", 2), ("7", 1)}


def brute(baskets):
    pairs, items = Counter(), Counter()
    for b in baskets:
        s = sorted({x for x in (b or []) if x is not None})
        items.update(s)
        pairs.update(itertools.combinations(s, 2))
    return pairs, items


def frame(spark, baskets):
    return spark.createDataFrame([("f", b) for b in baskets], "field_name string, items array<string>")


def check(table, baskets):
    pairs, items = brute(baskets)
    got = {(r.item_a, r.item_b): r for r in table.scores().collect()}
    assert {k: r.n_ab for k, r in got.items()} == dict(pairs)
    for (a, b), r in got.items():
        assert (r.n_a, r.n_b, r.n_records) == (items[a], items[b], len(baskets))
        assert abs(r.lift - len(baskets) * pairs[a, b] / (items[a] * items[b])) < 1e-9


def test_increments_equal_recount(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, [], [None, "a"], *([rng.sample("abcdefgh", rng.randint(1, 5))] * 6), ["a", "a", "b"]])
    all_ = [pick() for _ in range(60)]
    table = co.PairTable(spark, bucket_rows=1)
    table.apply(frame(spark, all_))
    check(table, all_)
    # Some baskets change, some go, some come.
    old, new = all_[:20], [pick() for _ in range(25)]
    table.apply(frame(spark, new), frame(spark, old))
    now = all_[20:] + new
    check(table, now)
    table.apply(frame(spark, []), frame(spark, []))
    check(table, now)
    touched = spark.createDataFrame([("f", "a")], "field_name string, item string")
    assert all("a" in (r.item_a, r.item_b) for r in table.scores(touched).collect())
    table.apply(frame(spark, []), frame(spark, now))
    assert table.scores().count() == 0


def test_reopened_table_goes_on(spark, tmp_path):
    rng = random.Random(6)
    pick = lambda: rng.sample("abcdefgh", rng.randint(1, 5))
    first, more, last = ([pick() for _ in range(n)] for n in (40, 10, 5))
    co.PairTable(spark, str(tmp_path)).apply(frame(spark, first))
    table = co.PairTable(spark, str(tmp_path))
    check(table, first)
    table.apply(frame(spark, more), frame(spark, first[:10]))
    check(co.PairTable(spark, str(tmp_path)), first[10:] + more)
    # A merge that dies before its manifest leaves the last version whole.
    table._commit = lambda *_: (_ for _ in ()).throw(OSError("died"))
    try:
        table.apply(frame(spark, last))
    except OSError:
        pass
    check(table, first[10:] + more)
    again = co.PairTable(spark, str(tmp_path))
    again.apply(frame(spark, last))
    again.clean()
    check(co.PairTable(spark, str(tmp_path)), first[10:] + more + last)
    assert len(list((tmp_path / "totals").glob("[0-9a-f]*"))) == 1


def test_buckets_follow_rows(spark):
    rng = random.Random(8)
    first, more = ([rng.sample([f"i{k}" for k in range(40)], 4) for _ in range(n)] for n in (10, 60))
    table = co.PairTable(spark, bucket_rows=3)
    table.apply(frame(spark, first))
    before = table.buckets
    table.apply(frame(spark, more))
    assert before == 16 < table.buckets
    check(co.PairTable(spark, table.folder), first + more)


def test_long_basket_and_thresholds(spark):
    table = co.PairTable(spark)
    table.apply(frame(spark, [[f"i{k:04d}" for k in range(400)]] + [["a", "b"]] * 4 + [["c"]] * 40))
    assert table.scores().count() == 400 * 399 // 2 + 1
    assert [(r.item_a, r.item_b) for r in co.associated(table.scores(least=4, per=2000)).collect()] == [("a", "b")]


def test_focus_terms(spark):
    docs = spark.createDataFrame([(1, "The Night-market; night owl"), (2, None), (3, "nightmarket"), (4, "NIGHT\nmarket night market")], "rec_id long, abstract string")
    focus = spark.createDataFrame([("night market",), ("owl",), (None,)], "term string")
    for size in (TERM_BYTES, 0):
        assert {r.rec_id: r["items"] for r in focus_baskets(docs, focus, size).collect()} == {1: ["night market", "owl"], 4: ["night market"]}
    assert focus_baskets(docs, focus.limit(0)).count() == 0
    assert focus_baskets(docs.where(F.lit(False)), focus).count() == 0
