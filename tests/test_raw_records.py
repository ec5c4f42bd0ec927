import random

import pytest

from lexiweave.operators import raw_records as rr

LONG = "Some twenty letters of text at least."


def line(corp="c1", doc="12", abstract=LONG, tail=""):
    return f'{corp},{doc},t,a,"{abstract}",,,2001,{tail}'


CASES = [
    (line(), None),
    (line(abstract="with ""doubled"" and more letters".replace('""', '""')), None),
    (line(abstract='it said ""yes"" and so many letters'), None),
    (line(abstract="line\nbreak in quotes, many letters"), None),
    (line().replace(',a,', ",a\nb,"), None),
    (line(tail="x\n"), None),
    ('"c1"' + line()[2:], None),
    (line(tail='"x'), "quoting"),
    (line(tail='x"'), "quoting"),
    ('"c1" ' + line()[2:], "quoting"),
    (line(tail='a\\"b'), "quoting"),
    (line(tail="x,y"), "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    (line(corp="zz"), "corp_id"),
    (line(corp=" c1"), "corp_id"),
    (line(corp=""), "corp_id"),
    (line(corp="zz", doc="012", abstract="x"), "corp_id"),
    (line(doc="012"), "doc_id"),
    (line(doc="12345678901"), "doc_id"),
    (line(doc="1٢"), "doc_id"),
    (line(doc="0"), None),
    (line(abstract="short"), "abstract"),
    (line(abstract="x\0" + LONG), "abstract"),
    (line(abstract="x�" + LONG), "abstract"),
    (line(abstract="дом" * 7), None),
    (line(abstract="文" * 19), "abstract"),
    (line(abstract="文" * 20), None),
    (line(abstract="word " * 100_000), None),
]


@pytest.mark.parametrize("most_bytes", [rr.PERIOD_BYTES, 0])
def test_cases(spark, most_bytes):
    rows = [(i, x, "n") for i, (x, _) in enumerate(CASES)] * 2
    random.Random(1).shuffle(rows)
    raw = spark.createDataFrame(rows, "raw_id long, line string, reason string")
    corpora = spark.createDataFrame([("c1",), ("c2",), (None,)], "corp_id string")
    got = rr.load_records(raw, corpora, most_bytes=most_bytes).collect()
    assert len(got) == 2 * len(CASES)
    known = frozenset(["c1", "c2"])
    for r in got:
        text, want = CASES[r.raw_id]
        assert r.reason == want, (text or "")[:80]
        assert want is None or not any(r[c] for c in rr.COLUMNS)
        if want is None:
            assert [r[c] for c in rr.COLUMNS] == rr.diagnose(text, known)[1]


def test_failing_blocks_are_halved():
    import pyarrow as pa

    # A bare line break gives the reader a row too many; only that record is left out.
    lines = [line()] * 50 + [line().replace(",a,", ",a\nb,")] + [line()] * 49
    got = list(rr.parse_block(pa.array(lines)))
    assert sum(n for n, _ in got) == 100 and [n for n, t in got if t is None] == [1]
    known = frozenset(["c1"])
    pieces = list(rr._parse_lines(pa.array(range(100)), pa.array(lines), known, pa.array(["c1"])))
    assert all(r is None for _, r, _ in pieces) and sorted(i for ids, _, _ in pieces for i in ids.to_pylist()) == list(range(100))


def test_empty_tables(spark):
    raw = spark.createDataFrame([], "raw_id long, line string")
    corpora = spark.createDataFrame([], "corp_id string")
    assert rr.load_records(raw, corpora).count() == 0
    assert rr.rejects(spark.createDataFrame([(1, line())], "raw_id long, line string"), corpora).first()[1] == "corp_id"


def test_split_record():
    assert rr.split_record('a,"b,""c""",') == ["a", 'b,"c"', ""]
    assert rr.split_record("") == [""]
    assert rr.split_record('a"b') is None
