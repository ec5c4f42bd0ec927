"""Sentence boundaries across languages and scripts, by statistics learnt without supervision.

Pass 1 counts, for each language and word with a period, what follows the period: the end of the text, a capital, a
small letter, a digit or something else, and which word; and how often the word stands without one, whatever other marks
touch it. From these counts log-likelihood ratios give for each language

* abbreviations that never end a sentence: the word ends texts less often than words with periods do in general, or
  binds to its period (Dunning's ratio with penalties for length) and is followed by small letters or digits;
* collocations: a number with period and a word that follow one another more often than chance (dates);
* sentence starters: capitals that follow sure ends more often than other periods; they end a sentence even after a
  word held for an abbreviation by its form alone.

Pass 2 classifies each mark of each text with these tables. The language is the script or, for Latin script, the one
with most function words. Scripts without end marks are cut at blanks and line breaks that touch no digit. Wrongly
decoded texts are restored once, before both passes, and offsets are mapped back to the stored text.

Edge cases: null and blank texts have no sentences; a text without any end mark is one sentence; offsets count Unicode
characters of the stored text, white space around a sentence is not part of it; repeated rows come out each; texts
are read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweave.llm.garbled import restore_aligned
from lexiweave.llm.words import not_blank
from lexiweave.store import materialise

#: Chi-square of one degree of freedom at 0.005.
SURE = 7.88
#: Words learnt of each kind (abbreviations, dates and starters) at most; beyond this a model would not be sent to each task.
MOST_WORDS = 200_000

#: Letters of a word at most; words of more are known by the last of them.
LONGEST = 40

# A few function words of each language in Latin script, fixed values.
_FUNCTION_WORDS = {
    "en": "the of and to in is that for by with was were from",
    "fr": "le les des du et une dans est pour que au selon aux",
    "de": "der die das und für mit von zu den ist ein eine nicht",
    "es": "el los las y del una por para con según en se que",
    "pt": "o os as e do da em uma não com na no para",
    "it": "il gli di che e della per una con nel sono",
    "nl": "de het een van en in is dat op te",
}
_LANGUAGE = {}
for _lang, _words in _FUNCTION_WORDS.items():
    for _w in _words.split():
        _LANGUAGE.setdefault(_w, []).append(_lang)
_SCRIPTS = (("th", "[฀-๿]"), ("lo", "[຀-໿]"), ("km", "[ក-៿]"), ("my", "[က-႟]"), ("hi", "[ऀ-෿]"), ("ar", "[؀-ۿݐ-ݿ]"), ("he", "[֐-׿]"), ("ja", "[぀-ヿ]"), ("zh", "[一-鿿]"), ("ko", "[가-힯]"), ("ru", "[Ѐ-ӿ]"), ("el", "[Ͱ-Ͽ]"))
_SCRIPT = re.compile("|".join(f"({c}+)" for _, c in _SCRIPTS) + "|[A-Za-zÀ-ɏ]+")
_WORD = re.compile(r"[^\W\d_]+")

_OPEN, _CLOSE = "“„«»「『（(［[【〈《‹\"‚", "”“»«」』）)］]】〉》›\"‘"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）)", "(": ")）", "[": "]", "［": "］", "【": "】", "〈": "〉", "《": "》", "‹": "›", '"': '"'}
_BRACKET = re.compile('[“”„«»「」『』（）()\\[\\]［］【】〈〉《》‹›"]')
_CLOSERS = "”“»」』）)］]】〉》›\"’'"
_MARK = re.compile(r"[.!?。！？।॥؟۔｡．…]+")
_OPENERS = "“„«「『（([［【〈《‹\"‘'¿¡-–—*"
#: What may touch a word that has no period.
_TOUCHING = _OPENERS + _CLOSERS + ",;:!?{}，、；：。！？｡．।॥؟۔،؛"
_LATIN_END = re.compile(r"[a-zß-ɏ.'’-]+$")


def language(text: str) -> str:
    """Script of most letters of a text, or the language that has most of its function words in Latin script."""
    beyond = len(text) - len(text.encode("ascii", "ignore"))
    if beyond * 5 > len(text):
        scripts: Counter = Counter()
        for m in _SCRIPT.finditer(text):
            scripts[m.lastindex or 0] += m.end() - m.start()
        top = max(sorted(scripts), key=scripts.__getitem__) if scripts else 0
        # Japanese mixes Han characters with kana.
        if top and _SCRIPTS[top - 1][0] == "zh" and scripts[8] * 10 > scripts[top]:
            return "ja"
        if top:
            return _SCRIPTS[top - 1][0]
    seen: Counter = Counter()
    for w in _LANGUAGE.keys() & set(text.lower().split()):
        seen.update(_LANGUAGE[w])
    return max(sorted(seen), key=seen.__getitem__) if seen else "la"


def _key(text: str, end: int) -> str:
    """The word before a period, in lower case; digits count as one kind. Scripts without blanks have no longer words."""
    if not end or text[end - 1].isspace():
        return ""
    w = text[max(0, end - LONGEST) : end].rsplit(None, 1)[-1].lower()
    if w.isascii() and w.isalpha():
        return w
    w = w.lstrip("([{“„«\"'‘")
    if not w or w[-1] in _CLOSERS:
        return ""
    if w[-1].isdigit():
        return "#"
    # Latin letters that touch another script are a word of their own.
    return _LATIN_END.search(w)[0] if "a" <= w[-1] <= "z" else w


def _follows(text: str, at: int) -> tuple[str, str]:
    """Kind of what follows, past blanks and opening marks: E, U, L, D, O; and the word."""
    n = len(text)
    if at < n and text[at] == " ":
        at += 1
    while at < n and (text[at].isspace() or text[at] in _OPENERS):
        at += 1
    if at >= n:
        return "E", ""
    c = text[at]
    if c.isdigit():
        return "D", ""
    if c.isupper() or c.islower():
        m = _WORD.match(text, at)
        return ("U" if c.isupper() else "L"), m[0] if m else c
    return "O", ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a batch: language, word, what follows (or ``-`` for no period), next word, n."""
    for b in batches:
        got: Counter = Counter()
        plain: dict[str, Counter] = {}
        for s in b.column(0):
            text = s.as_py()
            lang = language(text)
            for m in _MARK.finditer(text):
                i, j = m.span()
                if m[0] != "." or (j < len(text) and text[j].isalnum() and not text[j].isupper()):
                    continue
                w = _key(text, i)
                k = j
                while k < len(text) and text[k] in _CLOSERS:
                    k += 1
                kind, x = _follows(text, k)
                # A line of its own ends the text as well as its end does.
                if kind != "E" and "\n\n" in text[k : k + 3]:
                    kind = "E"
                got[lang, w, kind, x if kind == "U" else ""] += 1
            plain.setdefault(lang, Counter()).update(text.lower().split())
        for lang, c in plain.items():
            for w, n in c.items():
                w = w if w.isalpha() else w.strip(_TOUCHING)
                # A word that ends in a period was counted above.
                if w and w[-1] != "." and (w := _key(w, len(w))):
                    got[lang, w, "-", ""] += n
        rows = [(*k, n) for k, n in got.items()]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.record_batch([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["lang", "word", "kind", "next", "n"])


def _llr(k1: float, n1: float, k2: float, n2: float) -> float:
    """Dunning's log-likelihood ratio of two proportions."""

    def part(k: float, n: float, p: float) -> float:
        p = min(max(p, 1e-9), 1 - 1e-9)
        return k * math.log(p) + (n - k) * math.log(1 - p)

    if not n1 or not n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    return 2 * (part(k1, n1, k1 / n1) + part(k2, n2, k2 / n2) - part(k1, n1, p) - part(k2, n2, p))


def _abbreviation(w: str, e: int, u: int, low: int, d: int, o: int, plain: int, total: tuple[int, int, int]) -> str | None:
    """``never`` for a word that never ends a sentence, ``weak`` for one held for an abbreviation by its form alone."""
    ends, all_, plains = total
    n = e + u + low + d + o
    if not n or w == "#":
        return None
    # Ends texts less often than words with a period do in general; a cut-off text may end on any word.
    rare_end = e / n < 0.25 * max(ends / all_, 0.05)
    sure_end = _llr(e, n, ends - e, all_ - n) > SURE
    inside = low + d > 0.5 * n
    letters = len(w.replace(".", ""))
    bound = _llr(n, n + plain, all_ - n, all_ - n + plains - plain) * math.exp(-letters) * (1 + w.count(".")) * float(max(letters, 1)) ** -min(plain, 30)
    if rare_end and (sure_end and n > 0.2 * (n + plain) or inside and n > 1):
        return "never"
    return "weak" if not e and (letters <= 1 or letters <= 3 and bound >= 0.3) else None


def _follower(number: int, abbr: int, sure: int, n_number: int, n_abbr: int, n_sure: int) -> tuple[bool, bool]:
    """Whether a capitalised word is a date after numbers, and whether it is a sentence starter.

    Its counts after numbers, abbreviations and sure ends; and those of all words.
    """
    date = number > 1 and number / n_number > 4 * sure / max(1, n_sure) and _llr(number, n_number, sure, n_sure or 1) > SURE
    others = number + abbr
    starter = bool(sure) and sure / n_sure > (sure + others) / (n_sure + n_number + n_abbr) and _llr(sure, n_sure, others, max(1, n_number + n_abbr)) > SURE
    return date, starter


class Model:
    """Per language: words that never end a sentence, dates after numbers, and sentence starters."""

    def __init__(self, words: list[tuple[str, str, str]]):
        """``words``: kind (never, weak, dates or starters), language, word."""
        self.never: set[tuple[str, str]] = set()
        self.weak: set[tuple[str, str]] = set()
        self.dates: set[tuple[str, str]] = set()
        self.starters: set[tuple[str, str]] = set()
        for kind, lang, w in words:
            getattr(self, kind).add((lang, w))


def _passing(table: DataFrame, judge: Callable[..., list[str]]) -> list[tuple[str, str, str]]:
    """Kind, language and word for each row (lang, word, counts) that a test accepts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(kind, lang, w) for lang, w, *counts in zip(*(c.to_pylist() for c in b.columns)) for kind in judge(lang, w, *counts)]
            yield pa.record_batch([pa.array(c, pa.string()) for c in list(zip(*got)) or [[]] * 3], names=["kind", "lang", "word"])

    found = [tuple(r) for r in table.mapInArrow(run, "kind string, lang string, word string").limit(MOST_WORDS + 1).collect()]
    if len(found) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} abbreviations, or dates and starters, were learnt; they can't be sent to each task")
    return found


def learn(texts: DataFrame) -> Model:
    """Statistics of the string column ``text`` over all rows, as they stand; see ``restored`` for wrongly decoded ones.

    All counts are tested where they lie; only the words that pass go to the driver. More than ``MOST_WORDS`` of
    them raise an error.
    """
    counts = texts.select("text").mapInArrow(_count, "lang string, word string, kind string, next string, n long").groupBy("lang", "word", "kind", "next").agg(F.sum("n").alias("n"))
    counts = materialise(counts)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    table = counts.groupBy("lang", "word").agg(*(of(k) for k in "EULDO"), of("-"))
    sums = table.groupBy("lang").agg(*(F.sum(k).alias(k) for k in [*"EULDO", "-"]))
    total = {r[0]: (r[1], sum(r[1:6]), r[6]) for r in sums.collect()}
    dotted = F.col("E") + F.col("U") + F.col("L") + F.col("D") + F.col("O")
    # What no abbreviation of either kind can lack, so that few words need the whole test.
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    bound = (dotted * 4 > F.col("-")) | ((F.col("L") + F.col("D")) * 2 > dotted)
    able = (dotted > 0) & (((letters <= 3) & (F.col("E") == 0)) | ((F.col("E") * 4 < dotted) & bound))
    words = _passing(table.where(able), lambda lang, w, *c: [kind] if (kind := _abbreviation(w, *c, total[lang])) else [])
    # What a period belongs to: at most MOST_WORDS abbreviations are known.
    known = texts.sparkSession.createDataFrame([(lang, w, True) for _, lang, w in sorted(words)], "lang string, word string, abbr boolean")
    pairs = counts.where("next <> ''").join(F.broadcast(known), ["lang", "word"], "left")
    own = lambda name, test: F.sum(F.when(test, F.col("n")).otherwise(0)).alias(name)
    number, abbr = F.col("word") == "#", F.coalesce("abbr", F.lit(False))
    after = pairs.groupBy("lang", "next").agg(own("number", number), own("abbr", ~number & abbr), own("sure", ~number & ~abbr))
    n_of = {r[0]: tuple(r[1:]) for r in after.groupBy("lang").agg(*(F.sum(c) for c in ("number", "abbr", "sure"))).collect()}

    def judge(lang: str, word: str, *c: int) -> list[str]:
        return [kind for kind, so in zip(("dates", "starters"), _follower(*c, *n_of[lang])) if so]

    return Model(words + _passing(after.where("number > 1 or sure > 0"), judge))


def _inside(text: str) -> list[tuple[int, int]]:
    """Outermost spans between matching quotes or brackets."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[int, int]] = []
    for m in _BRACKET.finditer(text):
        c, at = m[0], m.start()
        # The nearest open mark that this one closes; marks left open within it are void.
        k = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS[stack[k][1]]), None)
        if k is not None and not (c == '"' and at + 1 < len(text) and text[at + 1].isalnum()):
            start = stack[k][0]
            del stack[k:]
            while out and out[-1][0] > start:
                out.pop()
            out.append((start, at))
        elif c in _PAIRS and not (c in '»"' and at and not text[at - 1].isspace() and text[at - 1] not in "(（"):
            stack.append((at, c))
    return out


_SPACED_CLOSE = re.compile("[   ]»")
_NO_MARKS = re.compile("[฀-໿]")
_GAP = re.compile(r"\s+")


def boundaries(text: str, model: Model, lang: str | None = None) -> list[int]:
    """Offsets after the last character of each sentence but the rest of the text."""
    lang = lang or language(text)
    spans = _inside(text) if _BRACKET.search(text) else []
    ends: list[int] = []
    n, s = len(text), 0
    for m in _MARK.finditer(text):
        i, j = m.span()
        mark = m[0]
        if mark[0] == "…" and mark.strip("….") == "" or len(mark) > 1 and mark.strip(".…") == "":
            continue
        while s < len(spans) and spans[s][1] < i:
            s += 1
        k = j
        if s < len(spans) and spans[s][0] < i:
            # Within quotes or brackets: only a mark right before the closing one may end the sentence.
            close = spans[s][1]
            if text[j:close].strip():
                continue
            k = close + 1
        while k < n and text[k] in _CLOSERS and not (text[k] in "'\"“" and k + 1 < n and text[k + 1].isalnum()):
            k += 1
        if text[k + 1 : k + 2] == "»":
            k = _french(text, k) or k
        quoted = k > j
        if k >= n:
            ends.append(k)
            continue
        kind, word = _follows(text, k)
        if kind == "E":
            ends.append(k)
            continue
        gap = text[k].isspace()
        line = gap and (text[k] == "\n" or text[k + 1 : k + 2].isspace() and "\n" in _GAP.match(text, k)[0])
        if text[k] in ",;:、，；：":
            continue
        if mark != ".":
            if mark in "。！？｡．।॥" or "。" in mark:
                # Quotes within a sentence go on after their closing mark.
                if not quoted or line:
                    ends.append(k)
            elif kind == "L" and not line:
                continue
            elif quoted and kind == "O" and not line and not _opens(text, k):
                continue
            else:
                ends.append(k)
            continue
        w = _key(text, i)
        if kind == "L":
            continue
        if not gap and (kind == "D" or not quoted and kind == "U" and _acronym(text, i, j)):
            continue
        if not gap and kind == "O" and not _opens(text, k):
            continue
        if quoted:
            if kind == "O" and not line and not _opens(text, k):
                continue
            ends.append(k)
            continue
        if (lang, w) in model.never:
            continue
        if w == "#":
            if kind == "U" and (lang, word) in model.dates:
                continue
        elif (lang, w) in model.weak and (lang, word) not in model.starters:
            continue
        elif kind == "D" and (lang, w) in model.weak:
            continue
        ends.append(k)
    if lang in ("th", "lo", "km", "my") or _NO_MARKS.search(text):
        s = 0
        for m in _GAP.finditer(text):
            i, j = m.span()
            if not i or j >= n:
                continue
            while s < len(spans) and spans[s][1] < i:
                s += 1
            if s < len(spans) and spans[s][0] < i:
                continue
            before = text[i - 1]
            p = i - 1
            while p and text[p] in _CLOSERS:
                p -= 1
            q = j
            while q < n - 1 and text[q] in _OPENERS:
                q += 1
            if not before.isdigit() and not text[j].isdigit() and before not in ",;:" and _NO_MARKS.match(text[p]) and (_NO_MARKS.match(text[q]) or "\n" in m[0]):
                ends.append(i)
        ends = sorted(set(ends))
    return ends


def _opens(text: str, k: int) -> bool:
    """Whether the next mark opens a sentence, as those of Spanish or an opening quote do."""
    while k < len(text) and text[k].isspace():
        k += 1
    return k < len(text) and text[k] in _OPENERS and text[k] not in "-–—*'"


def _french(text: str, k: int) -> int:
    """The place after a closing quote that stands apart by a blank, or 0."""
    m = _SPACED_CLOSE.match(text, k)
    return m.end() if m and text.rfind("«", 0, k) > text.rfind("»", 0, k) else 0


def _acronym(text: str, i: int, j: int) -> bool:
    """Whether a period without a blank stands between single letters, as in U.S."""
    single = i > 0 and text[i - 1].isalpha() and (i < 2 or not text[i - 2].isalpha())
    after = j + 1 >= len(text) or not text[j + 1].isalpha()
    return single or after


def restored(texts: DataFrame) -> DataFrame:
    """rec_id, text and places for each rec_id and text: the text as it was meant, and where its characters are stored, null where as they are.

    Written to the shared folder, so both passes read it and each text is restored once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain, places = zip(*(restore_aligned(t) for t in b.column(1).to_pylist())) if b.num_rows else ((), ())
            yield pa.record_batch([b.column(0), pa.array(plain, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["rec_id", "text", "places"])

    return materialise(texts.select("rec_id", "text").mapInArrow(run, "rec_id long, text string, places array<int>"))


def sentences(text: str, model: Model) -> list[tuple[int, int]]:
    """Start and end of each sentence in the stored text."""
    return _placed(*restore_aligned(text), model)


def _placed(plain: str, places: list[int] | None, model: Model) -> list[tuple[int, int]]:
    out, at = [], 0
    for end in [*boundaries(plain, model), len(plain)]:
        piece = plain[at:end]
        if piece.strip():
            start = at + len(piece) - len(piece.lstrip())
            stop = at + len(piece.rstrip())
            out.append((start, stop) if places is None else (places[start], places[stop]))
        at = end
    return out


def sentence_units(df: DataFrame, key: str, text_col: str, model: Model | None = None) -> DataFrame:
    """rec_id, sent_no (from 1), sent_start, sent_end for each sentence of each text that isn't blank."""
    texts = df.where(not_blank(F.col(text_col))).select(F.col(key).cast("long").alias("rec_id"), F.col(text_col).alias("text"))
    texts = restored(texts)
    model = model or learn(texts)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids: list[int] = []
            no: list[int] = []
            starts: list[int] = []
            ends: list[int] = []
            for r, t, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                found = _placed(t.as_py(), p.as_py(), known)
                ids += [r] * len(found)
                no += range(1, len(found) + 1)
                starts += [a for a, _ in found]
                ends += [z for _, z in found]
            yield pa.record_batch([pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (no, starts, ends))], names=["rec_id", "sent_no", "sent_start", "sent_end"])

    return texts.mapInArrow(run, "rec_id long, sent_no int, sent_start int, sent_end int")
