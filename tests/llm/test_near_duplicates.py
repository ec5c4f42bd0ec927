import random

import numpy as np
import pytest

from lexiweave.llm import near_duplicates as nd
from lexiweave.llm.components import components

SCHEMA = "rec_id long, title string, abstract string, node string"


def brute(rows):
    import re

    texts = {r[0]: re.sub(r"\s+", " ", f"{r[1] or ''} {r[2]}".lower()) for r in rows if r[2] and r[2].strip()}
    group = {i: i for i in texts}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if texts[a] == texts[b] or nd.similarity(texts[a], texts[b]) >= nd.THRESHOLD:
                x, y = top(a), top(b)
                group[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def collection(n, seed):
    rng = random.Random(seed)
    syllables = ["mor", "pan", "vel", "nik", "tar", "lu", "ke", "bra", "zo", "quo"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        if i < 5 or rng.random() < 0.5:
            text = " ".join(word() for _ in range(rng.randint(8, 90)))
            title = rng.choice([None, word(), ""])
        else:
            _, title, base, _ = rng.choice(rows)
            ws = (base or "x").split()
            for _ in range(rng.randint(0, 1 + len(ws) // 6)):
                k = rng.randrange(len(ws))
                ws[k : k + 1] = rng.choice([[], [word()], [ws[k], word()]])
            if rng.random() < 0.2:
                h = len(ws) // 2
                ws = ws[h:] + ws[:h]
            text = rng.choice([" ", "  ", "\n"]).join(ws)
        rows.append((i * 3 + 1, title, text, "clash"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_groups_as_brute_force(spark, seed):
    rows = collection(220, seed) + [(9001, None, None, "x"), (9002, "t", "  \n", "x"), (9003, None, "ab", "x"), (9004, "", "ab", "x"), (9005, None, "ac", "x")]
    got = nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA))
    assert {r.rec_id: r.group_id for r in got.collect()} == brute(rows)
    pairs = {(r.rec_a, r.rec_b) for r in nd.group_pairs(got).collect()}
    g = brute(rows)
    assert pairs == {(a, b) for a in g for b in g if a < b and g[a] == g[b]}


def test_exact_mode_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_NODES", 25)
    rows = collection(200, 3) + [(9001, None, None, "x"), (9003, None, "ab", "x"), (9004, "", "ab", "x"), (9005, None, "ac", "x")]
    rows += [(9100 + i, None, " ".join(f"word{k:03d}" for k in range(60) if k != i % 60) + f" end{i}", "x") for i in range(100)]
    got = nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA), exact=True).collect()
    assert {r.rec_id: r.group_id for r in got} == brute(rows)
    import re

    texts = {r[0]: re.sub(r"\s+", " ", f"{r[1] or ''} {r[2]}".lower()) for r in rows if r[2] and r[2].strip()}
    want = {i: len({u for u in texts.values() if u != t and nd.similarity(t, u) >= nd.THRESHOLD}) for i, t in texts.items()}
    assert {r.rec_id: r.n_links for r in got} == want and max(want.values()) >= 99
    assert nd.near_duplicate_groups(spark.createDataFrame([], SCHEMA), exact=True).count() == 0


def test_empty_and_repeated(spark):
    assert nd.near_duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, "Same", "the very same text again", "x") for i in range(300)]
    got = nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 300 and {r.group_id for r in got} == {0} and {r.n_links for r in got} == {0}


def test_large_buckets_lose_no_link(spark):
    # 150 texts that differ in a few letters share buckets beyond the cap.
    base = " ".join(f"w{i:03d}" for i in range(120))
    rows = [(i, None, base + f" tail{i:04d} {i * 7919 % 10007}", "x") for i in range(150)] + [(1000, None, "something else altogether, and long enough", "x")]
    got = {r.rec_id: r.group_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[i] for i in range(150)} == {0} and got[1000] == 1000


def test_links_of_large_groups_are_all_counted(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"word{i:03d}" for i in range(100)]
    rows = []
    for i in range(240):
        ws = list(base)
        for k in rng.sample(range(100), rng.randint(1, 12)):
            ws[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, None, " ".join(ws), "x"))
    rows += [(1000, None, rows[0][2], "x"), (1001, None, "something else altogether, and long enough", "x")]
    texts = {i: " " + t for i, _, t, _ in rows}
    want = {i: sum(texts[j] != texts[i] and nd.similarity(texts[i], texts[j]) >= nd.THRESHOLD for j in texts if j != 1000) for i in texts}
    assert max(want.values()) > 130 and len({want[i] for i in range(240)}) > 1
    for size in (1000, 50):
        monkeypatch.setattr(nd, "BLOCK_TEXTS", size, raising=False)
        assert {r.rec_id: r.n_links for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_pairs_over_batches_equal_one_batch():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 40, 4000))
    node = np.concatenate([np.sort(rng.integers(0, 500, n)) for n in np.unique(key, return_counts=True)[1]])
    batch = lambda a, z: pa.record_batch([pa.array(key[a:z]), pa.array(node[a:z])], names=["key", "node"])

    def run(cuts):
        out = set()
        for b in nd._pair_rows(batch(a, z) for a, z in zip(cuts, cuts[1:])):
            out |= set(zip(*(c.to_pylist() for c in b.columns)))
        return out

    one = run([0, 4000])
    assert run([0, 1, 100, 101, 2000, 4000]) == one
    assert run(list(range(0, 4001, 40))) == one


def test_long_text(spark):
    long = " ".join(f"token{i % 5000}" for i in range(60_000))
    rows = [(1, None, long, "x"), (2, None, long + " and a little more", "x"), (3, None, "short one here", "x")]
    got = {r.rec_id: r.group_id for r in nd.near_duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (7, 8), (9, 8), (10, 10), (5, 6)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 7)} == {1} and got[9] == got[7] == 7 and got[149] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
