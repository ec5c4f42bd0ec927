"""The three-document data set whose graph was worked out by hand, through readers, indexing, graphs, edits and sinks."""

import hashlib
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lexiweave.config import DOCUMENT_GRAPH, Extraction, GraphConfig
from lexiweave.operators import graph, index, report, search
from lexiweave.plans.api import Engine
from lexiweave.sources import readers
from lexiweave.streaming.incremental import index_stream

CSV = '''"corp_id","doc_id","title","acronym","abstract"
"FET","59","Analysis and visualisation of networks","ALPHA","The TEAM works. Analysis and visualisation of ""good"" scientific research, visualisation again."
"FET","60","Maps","BETA","Team for analysis and visualization.
Scientific research with visualization and interactive assessment by the team"
"FET","55","Single","GAMMA","A team alone."
'''
WL = '''"status","label","pos tag","total occs","ngram forms"
"w","visualisation","x","1","visualization *** visualisation"
" w ","interactive assessment","x","1","interactive assessment"
"w","analysis and visualisation","x","1","analysis and visualisation *** analysis and visualization"
"w","scientific research","x","1","scientific research"
"w","TEAM X","x","1","team *** TEAM"
"s","networks","x","1","networks"
"","maps","x","1","maps"
'''


def nid(label):
    return hashlib.sha256(label.lower().encode()).hexdigest()


LABELS = {nid(x): x for x in ("visualisation", "interactive assessment", "analysis and visualisation", "scientific research", "TEAM X")}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sets")
    (root / "docs.csv").write_text(CSV)
    (root / "wl.csv").write_text(WL)
    engine = Engine(spark, str(root))
    again = engine.index_file(f"recordcsv://{root}/docs.csv", "demo", f"{root}/wl.csv")
    assert again.count() == 0
    return engine, root


def test_reader(spark, made):
    _, root = made
    rows = {r.doc_id: r for r in readers.open_source(spark, f"recordcsv://{root}/docs.csv").collect()}
    assert set(rows) == {"59", "60", "55"} and rows["59"].label == "ALPHA" and '"good"' in rows["59"].content and "\n" in rows["60"].content
    with pytest.raises(ValueError):
        readers.open_source(spark, "nosuch://x")
    wl = {r.form: r.label for r in readers.whitelist_csv(spark, f"{root}/wl.csv").collect()}
    assert wl["team"] == "TEAM X" and "networks" not in wl and "maps" not in wl and len(wl) == 7


def test_uneven_rows_are_kept(spark, tmp_path):
    head = "corp_id,doc_id,title,acronym,abstract,x"
    (tmp_path / "u.csv").write_text(f'{head}\nFET,1,t,A,"one, text",y\nFET,2,t,B,two\nFET,3,t,C,"three ""x""\nmore",y,over,"a, b"\nFET,4\nFET,5,t,D,"never closed,y\nFET,6,t,E,six,y\n')
    rows = {r.doc_id: r.content for r in readers.open_source(spark, f"recordcsv://{tmp_path}/u.csv").collect()}
    assert rows == {"1": "one, text", "2": "two", "3": 'three "x"\nmore', "4": ""}
    table = readers.open_source(spark, f"basecsv://{tmp_path}/u.csv")
    assert table.columns == head.split(",") and table.count() == 4
    assert {(r.doc_id, r.x) for r in table.select("doc_id", "x").collect()} == {("1", "y"), ("2", ""), ("3", "y"), ("4", "")}
    aside = readers.csv_uneven(spark, f"{tmp_path}/u.csv").collect()
    assert sorted((r.record.split(",")[1], r.reason, r.surplus) for r in aside) == [("2", "missing_cells", None), ("3", "surplus_cells", ["over", "a, b"]), ("4", "missing_cells", None), ("5", "quoting", None)]
    (tmp_path / "w.csv").write_text("status,label,pos tag,total occs,ngram forms,y\nw,team,x,1,team *** Team\nw,map,x,1,map,z,surplus\n")
    assert {r.form for r in readers.whitelist_csv(spark, f"{tmp_path}/w.csv").collect()} == {"team", "map"}


def test_golden_graph(spark, made):
    engine, root = made
    nodes, edges = engine.generate_graph("demo", out=f"{root}/g", document_graph=GraphConfig(proximity="shared_ngrams", max_degree=100))
    w = {LABELS[r.id]: r.weight for r in nodes.where("category = 'NGram'").collect()}
    assert w == {"TEAM X": 3, "visualisation": 2, "analysis and visualisation": 2, "scientific research": 2, "interactive assessment": 1}
    assert {r.id: r.weight for r in nodes.where("category = 'Document'").collect()} == {"59": 1, "60": 1, "55": 1}
    got = {(LABELS[r.src], LABELS[r.dst]): r.weight for r in edges.where("src_category = 'NGram' and dst_category = 'NGram'").collect()}
    heavy = ["TEAM X", "visualisation", "analysis and visualisation", "scientific research"]
    want = {(a, b): 2.0 for a in heavy for b in heavy if a != b}
    want |= {p: 1.0 for a in heavy for p in ((a, "interactive assessment"), ("interactive assessment", a))}
    assert got == want
    docs = {(r.src, r.dst): r.weight for r in edges.where("src_category = 'Document' and dst_category = 'Document'").collect()}
    assert docs == {("59", "60"): 4, ("60", "59"): 4, ("59", "55"): 1, ("55", "59"): 1, ("60", "55"): 1, ("55", "60"): 1}
    links = {(r.src, LABELS[r.dst]): r.weight for r in edges.where("src_category = 'Document' and dst_category = 'NGram'").collect()}
    assert links["59", "visualisation"] == 3 and links["55", "TEAM X"] == 1
    text = "".join(p.read_text() for p in sorted((root / "g").glob("part-*")))
    tree = ET.fromstring(text.encode())
    ns = "{http://www.gexf.net/1.1draft}"
    assert len(tree.findall(f".//{ns}node")) == 8 and len(tree.findall(f".//{ns}edge")) == edges.where("weight <> 0").count()


def test_reindexing_changes_nothing(spark, made):
    engine, root = made
    before = sorted(map(tuple, engine.dataset("demo").read("doc_ngram").collect()))
    again = engine.index_file(f"recordcsv://{root}/docs.csv", "demo", f"{root}/wl.csv")
    assert again.count() == 3
    assert sorted(map(tuple, engine.dataset("demo").read("doc_ngram").collect())) == before


def test_extract_and_cooc_export(spark, made):
    engine, root = made
    rows = engine.extract_file(f"recordcsv://{root}/docs.csv", out=f"{root}/cand", stops=readers.stop_ngrams(spark, ["research"])).collect()
    labels = {r.label for r in rows}
    assert "scientific research" in labels and "research" not in labels
    lines = [x for p in (root / "cand").glob("part-*") for x in p.read_text().splitlines()]
    assert lines[0].startswith('"status","label"') and len(lines) == len(rows) + 1
    assert engine.export_cooc("demo", "FET", min_cooc=2).count() == 6
    with pytest.raises(ValueError):
        engine.generate_graph("demo", periods=["none"])


def test_forms(spark, made):
    engine, _ = made
    assert tuple(engine.add_form("demo", "alone").first()) == ("alone", 1)
    assert tuple(engine.delete_form("demo", "alone", nid("alone")).first()) == ("alone", 1)
    assert engine.dataset("demo").load("doc_ngram", "ngram_id", nid("alone")).count() == 0


def test_forms_of_an_ngram(spark, made):
    engine, _ = made
    data = engine.dataset("demo")
    seen = nid("visualisation")
    occs = lambda: {r.doc_id: r.occs for r in data.load("doc_ngram", "ngram_id", seen).collect()}
    before = occs()
    # One of two forms: the n-gram stays where the other one stands.
    assert engine.delete_form("demo", "visualization", seen).first().doc_count == len(before)
    assert occs() == {"59": 3} and {r.form for r in data.load("doc_form", "ngram_id", seen).collect()} == {"visualisation"}
    engine.delete_form("demo", "visualisation", seen)
    assert occs() == {} and data.load("doc_form", "ngram_id", seen).count() == 0


def test_listings_search_and_master(spark, made):
    engine, root = made
    assert engine.datasets() == ["demo"] and "whitelist_master" in engine.dataset("demo").tables()
    master = {r.label: r for r in engine.dataset("demo").read("whitelist_master").collect()}
    assert master["team"].status == "w" and master["team"].total == 3 and master["team"].periods == "FET"
    (path,) = engine.whitelists()
    assert path.endswith("demo_master")
    again = engine.whitelist("demo_master")
    assert {r.form for r in again.collect()} >= {"team", "scientific research"} and engine.whitelist("demo").count() == 7
    assert {r.doc_id for r in engine.search("demo", ["scientific research", "TEAM"]).collect()} == {"59", "60"}
    assert engine.search("demo", ["research scientific"]).count() == 0
    (root / "sources").mkdir()
    (root / "sources" / "a.csv").write_text("x")
    (root / "sources" / "~b.csv").write_text("x")
    assert [p.rsplit("/", 1)[-1] for p in engine.source_files()] == ["a.csv"] and engine.user_files("demo", "gexf") == []
    assert not engine.delete_whitelist(f"{root}/docs.csv") and engine.delete_whitelist(path) and engine.whitelists() == []


def test_dataset_parts(spark, tmp_path):
    from lexiweave.plans.dataset import Dataset

    data = Dataset(spark, str(tmp_path), "d")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert not data.exists("t") and data.tables() == []
    data.merge("t", rows((1, "a"), (2, "b")), ["k"])
    data.merge("t", rows((2, "x"), (3, "c")), ["k"])
    assert {tuple(r) for r in data.read("t").collect()} == {(1, "a"), (2, "b"), (3, "c")} and len(data._current("t")[1]) == 2
    data.upsert("t", rows((2, "y"), (4, "d")), ["k"])
    assert {tuple(r) for r in data.read("t").collect()} == {(1, "a"), (2, "y"), (3, "c"), (4, "d")}
    # Two writers that start from the same manifest.
    other = Dataset(spark, str(tmp_path), "d")
    stale = other._current("t")[0]
    data.delete("t", "k", 1)
    with pytest.raises(RuntimeError):
        other._add("t", rows((9, "z")), stale, [])
    data.clean("t")
    assert data.read("t").count() == 3 and len([p for p in (tmp_path / "d" / "t").iterdir() if p.is_dir()]) == 1


def test_frequent_items_are_cut_into_blocks(spark, monkeypatch):
    import itertools
    import random

    rng = random.Random(4)
    sets = {d: set(rng.sample(range(1, 30), rng.randint(1, 6))) | ({0} if d % 3 else set()) for d in range(90)}
    links = spark.createDataFrame([(d, i) for d, s in sets.items() for i in s], "doc_id long, ngram_id long")
    df = links.groupBy("ngram_id").agg(F.count("*").alias("df"))
    shared = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2)}
    whole = {(r.a, r.b): r.weight for r in graph.log_jaccard(links, df).collect()}
    monkeypatch.setattr(graph, "BLOCK_DOCUMENTS", 20)
    for least in (1, 2, 3):
        got = graph.shared_items(links, least=least).collect()
        assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b): r.shared for r in got} == {k: n for k, n in shared.items() if n >= least}
    got = graph.log_jaccard(links, df, least=0.3).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == {k for k, w in whole.items() if w >= 0.3}


def test_object_updates(spark, made):
    rows = [("NGram", "n", "Document", "d", 2, 1), ("NGram", "n", "Document", "d", 3, 2), ("Corpus", "c", "Document", "d", 1, 1), ("Corpus", "c", "Document", "d", 1, 2), ("NGram", "n", "NGram", "m", 4, 1), ("NGram", "n", "NGram", "m", 7, 2), ("NGram", "n", "Document", "e", 1, 1), ("NGram", "n", "Document", "e", -1, 2)]
    got = index.merge_objects(spark.createDataFrame(rows, "category string, id string, target string, neighbour string, weight long, seq long")).collect()
    assert {(r.category, r.target, r.neighbour): r.weight for r in got} == {("NGram", "Document", "d"): 5, ("Corpus", "Document", "d"): 1, ("NGram", "NGram", "m"): 7}
    engine, _ = made
    links = engine.dataset("demo").read("doc_ngram")
    one = links.limit(1)
    n = links.count()
    assert engine.update("demo", "doc_ngram", one.withColumn("occs", F.lit(0).cast("long")), ["corpus_id", "doc_id", "ngram_id"]).count() == n - 1
    with_own = Engine(spark, engine.root, stemmer=index.identity_stems)
    assert with_own.extract_file(f"recordcsv://{engine.root}/docs.csv").count() > 0


def test_numbered_and_sorted_files(spark, tmp_path):
    words = [f"w{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    assert {r.term: r.i for r in report.numbered(df, "term").collect()} == {w: i for i, w in enumerate(sorted(words), 1)}
    report.write_csv(df, f"{tmp_path}/s", order=["term"])
    lines = [x for p in sorted((tmp_path / "s").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['"term"', *(f'"{w}"' for w in sorted(words))]


def test_stream_equals_batch(spark, made, tmp_path):
    engine, root = made
    docs = readers.open_source(spark, f"recordcsv://{root}/docs.csv")
    wl = readers.whitelist_csv(spark, f"{root}/wl.csv")
    for i in range(2):
        docs.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    data = engine.dataset("streamed")
    q = index_stream(stream, data, wl, str(tmp_path / "cp"))
    q.awaitTermination(120)
    key = lambda r: (r.doc_id, r.ngram_id, r.occs)
    want = index.index_documents(docs, wl)
    assert sorted(map(key, data.read("doc_ngram").collect())) == sorted(map(key, want.collect()))


def test_medline(spark, tmp_path):
    rec = "PMID- 1\nDP  - 1999 Jan\nTI  - A title\n      that goes on\nAU  - One\nAU  - Two\nAB  - Text of it\n      and more.\n"
    (tmp_path / "1999").mkdir()
    (tmp_path / "1999" / "1999.txt").write_text(rec + "\nPMID- 2\nTI  - no date\nAB  - x\n\nPMID- 3\nDP  - 2001\nAB  - last, without a blank line")
    rows = {r.doc_id: r for r in readers.medline_archive(spark, str(tmp_path), ["1999"]).collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"].title == "A title that goes on" and rows["1"].record["AU"] == ["One", "Two"] and rows["1"].corpus_id == "1999"
    wl = spark.createDataFrame([("text of", "L"), ("more", "M")], "form string, label string")
    m = Engine(spark, str(tmp_path)).index_archive(str(tmp_path), ["1999"], wl, min_cooc=1)
    assert {(r.i, r.j, r.cooc) for r in m.collect()} == {(1, 1, 1), (1, 2, 1), (2, 2, 1)}
    engine = Engine(spark, str(tmp_path))
    engine.index_archive(str(tmp_path), ["1999"], wl, out=f"{tmp_path}/m", min_cooc=1, store="arch")
    assert {(r.corpus_id, r.a, r.b, r.cooc) for r in engine.archive("arch", "1999").collect()} == {("1999", "L", "L", 1), ("1999", "L", "M", 1), ("1999", "M", "M", 1)}
    assert "".join(p.read_text() for p in sorted((tmp_path / "m-terms").glob("part-*"))).split() == ['"L"', '"M"']


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "mixed"])
def test_medline_line_ends(spark, tmp_path, end):
    recs = [f"PMID- {i}\nDP  - 200{i}\nTI  - T{i}\nAB  - text {i}\n      goes on" for i in range(4)]
    text = "\n\n\n".join(recs[:2]) + "\n \n" + "\n\n".join(recs[2:])
    raw = text.replace("\n", end).encode() if end != "mixed" else ("\n\n".join(recs[:2]) + "\n\n" + "\n\n".join(recs[2:]).replace("\n", "\r\n")).encode()
    (tmp_path / "m.txt").write_bytes(raw.replace(b"text 1", b"te\xffxt 1"))
    got = {r.doc_id: (r.corpus_id, r.title, r.content) for r in readers.medline(spark, f"{tmp_path}/m.txt").collect()}
    assert got == {str(i): (f"200{i}", f"T{i}", f"text {i} goes on") for i in range(4)}
    (tmp_path / "l.txt").write_bytes("PMID- 1\nDP  - 1999\nAB  - Größe".encode("latin-1"))
    assert readers.medline(spark, f"{tmp_path}/l.txt", encoding="ISO-8859-1").first().content == "Größe"
    with pytest.raises(ValueError):
        readers.medline(spark, f"{tmp_path}/none.txt")


def test_stop_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_bytes(b"The\r\nof the\r\n\r\n a \r\n")
    want = {("the", 1), ("of the", 2), ("a", 1)}
    assert {tuple(r) for r in readers.stop_ngrams(spark, f"{tmp_path}/s.txt").collect()} == want
    for source in (["the", "of the", "a"], [["the"], ["of", "the"], ["a"]], [[["the"], ["a"]], [["of", "the"]]]):
        stops = readers.stop_ngrams(spark, source)
        assert {tuple(r) for r in stops.collect()} == want
    assert {r.label for r in readers.add_stops(stops, "An", "a").collect()} == {"the", "of the", "a", "an"}


def test_graph_properties(spark):
    rows = [("p", d, g) for d in range(12) for g in range(8) if (d * 7 + g * 3) % 5 < 2]
    links = spark.createDataFrame(rows, "corpus_id string, doc_id long, ngram_id long")
    df = index.document_frequency(links)
    nodes = graph.node_weights(df, "ngram_id")
    cooc = graph.sum_periods(graph.cooccurrence(links))
    e = graph.ngram_graph(cooc, nodes, GraphConfig())
    pairs = {(r.src, r.dst): r.weight for r in e.collect()}
    o = {r.node: r.w for r in nodes.collect()}
    assert all(pairs[b, a] == w and w <= min(o[a], o[b]) for (a, b), w in pairs.items())
    sets = {}
    for _, d, g in rows:
        sets.setdefault(d, set()).add(g)
    import math

    w = lambda s: sum(1 / math.log1p(o[g]) for g in s)
    lj = {(r.a, r.b): r.weight for r in graph.log_jaccard(links, nodes.select(F.col("node").alias("ngram_id"), F.col("w").alias("df"))).collect()}
    want = {(a, b): w(sets[a] & sets[b]) / w(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert lj.keys() == want.keys() and all(abs(lj[k] - want[k]) < 1e-9 and 0 <= lj[k] <= 1 + 1e-9 for k in want)
    top = graph.max_degree(graph.mirror(cooc), 2).groupBy("src").count().collect()
    assert all(r["count"] <= 2 for r in top)


def test_period_maxima_and_csv(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 1, 5)], "corpus_id string, k long, df long")
    sizes = spark.createDataFrame([("a", 4), ("b", 4), ("c", 0)], "corpus_id string, docs long")
    r = report.period_maxima(df, sizes, "k", F.lit(2)).first()
    assert (r.max_occs, r.max_period, r.max_occs_n, r.max_period_n) == (0.5, "b", 1.0, "b")
    line = report.csv_line(spark.createDataFrame([('say "x"', 1.005, 3, None)], "a string, b double, c long, d string")).first()[0]
    assert line.split(",")[0] == "\"say 'x'\"" and line.split(",")[2:] == ["3", '""']


def test_edges_and_search(spark):
    e = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 5, 3)], "k string, weight long, seq long")
    assert [index.merge_edges(e, p, ["k"]).first().weight for p in ("unique", "overwrite", "sum")] == [1, 5, 8]
    docs = spark.createDataFrame([("1", "Big data, here."), ("2", "big datas"), ("3", None)], "doc_id string, content string")
    assert [r.doc_id for r in search.phrase_search(docs, ["big data"]).collect()] == ["1"]
    both, refused = search.insert_new(docs, spark.createDataFrame([("1", "new"), ("9", "new")], docs.schema))
    assert both.count() == 4 and [r.doc_id for r in refused.collect()] == ["1"]
    assert search.insert_new(docs, spark.createDataFrame([("1", "new")], docs.schema), overwrite=True)[0].where("content = 'new'").count() == 1
    assert search.by_prefix(docs, "1").count() == 1 and search.phrase_count(docs, ["big"]).first()[0] == 2


def test_defaults():
    assert DOCUMENT_GRAPH.max_degree == 100 and Extraction().ngram_max == 4


def test_queries_on_all_ngram_lengths(spark, tmp_path):
    import re

    from lexiweave.functions import tagging
    from lexiweave.plans.core_queries import QUERIES

    texts = [("s1", 1, "Deep Neural nets of Paris work. Deep neural nets"), ("s1", 2, "deep neural Nets of paris, and more"), ("s2", 3, "Deep neural nets of Paris"), ("s2", 4, "the")]
    spark.createDataFrame(texts, "source string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = []
    for c, d, t in texts:
        ws = re.sub(r'[,.;:!?"\[\]{}()<>]', " ", t).split()
        grams += [(c, str(d), " ".join(ws[i : i + n])) for n in range(1, 5) for i in range(len(ws) - n + 1)]
    run = lambda name: QUERIES[f"{name}_1_4"](spark, str(tmp_path)).collect()
    terms = {f.lower() for *_, f in grams}
    tags = lambda t: [next((k for p, k in tagging.WORD_PATTERNS if re.search(p, w)), "?") for w in t.split()]
    assert {r.term: r.ngram_id for r in run("ngram_ids")} == {t: nid(t) for t in terms}
    assert {(r.doc_id, r.term): r.occs for r in run("doc_ngram_occs")} == {k: [(d, f.lower()) for _, d, f in grams].count(k) for k in {(d, f.lower()) for _, d, f in grams}}
    assert {r.term for r in run("min_word_size")} == {t for t in terms if min(map(len, t.split())) >= 4}
    both = tagging.CONTENT_RULES["both"]
    assert {r.term for r in run("content_rules")} == {t for t in terms if t.split()[0] not in both and t.split()[-1] not in both}
    assert {r.term for r in run("postag_valid")} == {t for t in terms if re.search(tagging.POSTAG_VALID, ",".join(tags(t)) + ",")}
    any_, both, begin = (tagging.TAG_RULES[k] for k in ("any", "both", "begin"))
    assert {r.term for r in run("postag_filter")} == {t for t in terms if not set(tags(t)) & set(any_) and tags(t)[0] not in (*both, *begin) and tags(t)[-1] not in both}
    forms = {t: {f for *_, f in grams if f.lower() == t} for t in terms}
    assert {r.ngram_id: (r.label, r.n_forms) for r in run("major_form")} == {t: (max(f), len(f)) for t, f in forms.items()}
    docs = {t: {(c, d) for c, d, f in grams if f.lower() == t} for t in terms}
    got = {r.ngram_id: r for r in run("whitelist_report")}
    assert set(got) == {t for t in terms if len(docs[t]) >= 3} and "deep neural nets of" in got
    for t, r in got.items():
        n = len(t.split())
        df = {c: sum(x == c for x, _ in docs[t]) for c in ("s1", "s2")}
        assert (r.label, r.total, r.length, r.total_n, r.max_occs, r.max_occs_n) == (max(forms[t]), len(docs[t]), n, len(docs[t]) ** n, max(df.values()) / 2, max(df.values()) ** n / 2)
        assert r.postag == ",".join(tags(r.label)) and r.forms == " *** ".join(sorted(forms[t]))
