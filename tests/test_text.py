import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiweave.functions import tagging
from lexiweave.functions import text as tx
from lexiweave.functions.stemming import porter, vocabulary_stems


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokens_and_ngrams(spark):
    assert one(spark, 'A (small) test: "of" words,', tx.tokens) == ["a", "small", "test", "of", "words"]
    assert one(spark, "", tx.tokens) == []
    assert one(spark, None, tx.tokens) is None
    assert one(spark, ["a", "b", "c"], lambda c: tx.word_ngrams(c, 1, 4), "array<string>") == ["a", "b", "c", "a b", "b c", "a b c"]
    assert one(spark, [], lambda c: tx.word_ngrams(c, 1, 2), "array<string>") == []


def test_ids(spark):
    assert one(spark, "TINA EC ICT", tx.ngram_id) == hashlib.sha256(b"tina ec ict").hexdigest()
    assert one(spark, "Détail", tx.ngram_id) == hashlib.sha256(b"d?tail").hexdigest()
    assert one(spark, "a b/c_d-é1", tx.clean_id) == "abc_d-1"


def test_select_content_skips_nulls(spark):
    df = spark.createDataFrame([("t", None), (None, None), ("t", "c")], "a string, b string")
    assert [r[0] for r in df.select(tx.select_content(F.col("a"), F.col("b"))).collect()] == [" . t", "", " . t . c"]


def test_sentences_and_treebank(spark):
    assert one(spark, "One thing. Two (things!) Three?", tx.sentences) == ["One thing.", "Two (things!)", "Three?"]
    assert one(spark, "He didn't say \"yes\", e.g. now.", tx.treebank_tokens) == ["He", "did", "n't", "say", '"', "yes", '"', ",", "e.g.", "now", "."]


def test_occurrences_escapes(spark):
    assert one(spark, "c.t cat C.T", lambda c: tx.occurrences(c, "c.t")) == 2


def test_tags(spark):
    words = ["12", "would", "running", "played", "kindness", "movement", "useful", "curious", "able", "basic", "active", "best", "a", ",", "word"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(tagging.tag(F.col("w"))).collect()] == "CD MD VBG VBD NN NN JJ JJ JJ JJ JJ JJ PREP PUN ?".split()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["NN", "?", "JJ", "VBG", "CD", "IN", "PUN", "PREP", "CC"]), min_size=1, max_size=5))
def test_grammar_is_the_same_in_java_and_python(spark, tags):
    want = re.match(tagging.POSTAG_VALID, ",".join(tags) + ",") is not None
    assert one(spark, tags, tagging.postag_valid, "array<string>") == want


def test_rules(spark):
    check = lambda v: one(spark, v, tagging.passes_rules, "array<string>")
    assert check(["data", "of", "time"]) and not check(["of", "time"]) and not check(["time", "of"]) and not check([])
    assert one(spark, ["abcd", "abc"], lambda c: tagging.min_word_size(c, 4), "array<string>") is False


def test_porter_published_examples(spark):
    pairs = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensitiviti:sensit sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electrical:electr goodness:good revival:reviv allowance:allow inference:infer adjustable:adjust replacement:replac adoption:adopt communism:commun activate:activ effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll"
    for p in pairs.split():
        word, stem = p.split(":")
        assert porter(word) == stem, word
    df = spark.createDataFrame([("cats",), ("cats",), (None,)], "token string")
    assert {(r.token, r.stem) for r in vocabulary_stems(df).collect()} == {("cats", "cat"), (None, None)}
