"""Garbled text from wrong character encoding: best-first search over encode, decode and unescape operations.

A state is a text. An operation undoes one wrong decoding: characters are encoded as the wrong charset would have
them and decoded as the right one. UTF-8 sequences are repaired wherever they stand in a text; other charsets on whole
passages. The queue is ordered by a cost of character plausibility (control characters, symbols and capitals inside
words, mixed scripts, rare letters, runs of accents); states that were met before are known by hash. The cheapest
text that was reached is the restored one. A field is searched as a whole, and where that leaves doubtful passages,
passage by passage. Replacement and control characters (U+FFFD, U+0080 to U+009F) show a wrong decoding even where
nothing can be restored.

Edge cases: null and empty fields are clean; pure ASCII without escapes is never searched; texts that stay doubtful
but for which no operation helps are clean; long texts are searched whole; repeated rows come out each; extra columns
are ignored.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts taken from the queue at most for one passage, operations in a row, and how much dearer than the text it came
#: from a text may be to enter the queue. None of them as None: the search then ends when no new text is reached.
EXPANSIONS, DEPTH, UPHILL = 24, 3, 5.0
#: A restored text must be cheaper by so much.
GAIN = 1.4


def _charset(name: str) -> list[str]:
    """The character of each byte; undefined bytes of Windows charsets pass as control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


# Wrong charsets that single bytes were read as.
_WRONG = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp1250", "cp850", "cp437", "koi8_r", "cp866")
# (right, wrong) charsets of single bytes.
_SINGLE = (
    ("cp1252", "latin-1"),
    ("cp1252", "cp850"),
    ("cp1252", "cp437"),
    ("cp1252", "mac_roman"),
    ("mac_roman", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1251", "cp1252"),
    ("koi8_r", "cp1251"),
    ("cp1251", "koi8_r"),
    ("koi8_r", "cp1252"),
    ("cp866", "cp1251"),
    ("cp1251", "cp866"),
    ("cp866", "cp1252"),
    ("cp1256", "cp1252"),
    ("cp1253", "cp1252"),
)
# Right charsets of several bytes whose bytes were read as Latin-1 or its Windows form.
_WIDE = ("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")
# Wrong charsets of several bytes that UTF-8 was read as.
_WIDE_WRONG = ("gb18030", "shift_jis", "euc_jp", "big5", "euc_kr")

_class = lambda chars: "[" + "".join(re.escape(c) for c in chars) + "]"


def _utf8_pattern(name: str) -> re.Pattern:
    t = _charset(name)
    cont = _class(t[0x80:0xC0])
    return re.compile(f"{_class(t[0xC2:0xE0])}{cont}|{_class(t[0xE0:0xF0])}{cont}{{2}}|{_class(t[0xF0:0xF5])}{cont}{{3}}")


_UTF8 = {n: (_utf8_pattern(n), {c: b for b, c in reversed(list(enumerate(_charset(n))))}) for n in _WRONG}
_SWAP = {(r, w): {ord(a): b for a, b in zip(_charset(w), _charset(r)) if a != b} for r, w in _SINGLE}
_CP1252 = {c: b for b, c in enumerate(_charset("cp1252"))} | {chr(b): b for b in range(128, 160)}
_LATIN_RUN = re.compile("[\x20-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*[\x80-\xff][\x20-\xff€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]*")
_ESCAPE = re.compile(r"&(?:#\d{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}|(?:%[0-9A-F]{2}){2,}|(?:=[0-9A-F]{2}){2,}")


def _common(c: str) -> bool:
    """Whether a Han character is in the first level of the Chinese or Japanese standard, by its code there."""
    try:
        if 0xB0 <= c.encode("gb2312")[0] <= 0xD7:
            return True
    except UnicodeEncodeError:
        pass
    try:
        return 0xB0 <= c.encode("euc_jp")[0] <= 0xCF
    except UnicodeEncodeError:
        return False


_RARE_HAN = "[" + "".join(chr(c) for c in range(0x4E00, 0xA000) if not _common(chr(c))) + "]"
_LOW, _UP = "a-zà-öø-ÿœßāăąćčďđēęěğīıłńňōőřśşšťūůűźżž", "A-ZÀ-ÖØ-Þ"
# Signs that stand inside words only in garbled text, letters that none of the usual orthographies has.
_SIGN = "¢£¤¥¦§¨©ª¬®¯±²³´µ¶·¸¹º¼½¾×÷ƒ†‡•‰‹›€™√∂∏∑∞∫≠≤≥≈∆Ω◊"
# Letters of two scripts side by side; Latin stands for itself, the others by their blocks.
_SCRIPTS = ("A-Za-zÀ-ÖØ-öø-ʯ", "Ͱ-Ͽ", "Ѐ-ӿ", "֐-׿", "؀-ۿ", "ऀ-ॿ", "฀-๿", "぀-ヿ一-鿿가-힯")
_MIXED = "|".join(f"(?<=[{a}])[{''.join(b for b in _SCRIPTS if b != a)}]" for a in _SCRIPTS[:-1]).replace(_SCRIPTS[-1], "") + f"|(?<=[{_SCRIPTS[-1]}])[a-zß-ʯЀ-ӿ]|(?<=[a-zß-ʯЀ-ӿ])[{_SCRIPTS[-1]}]"
_EVENTS: list[tuple[str, float]] = [
    ("[\x80-\x9f]", 5.0),
    ("[√∂∏∑∞∫≠≤≥≈∆Ω◊¬](?=[^\\s\\d])", 3.5),
    ("�", 3.0),
    ("[─-▟-｡-ﾟ]", 3.0),
    (f"(?<=[{_LOW}])[À-ÞŠŽŸĂÅŹŻĽŁ]", 3.0),
    (f"(?<=[{_LOW}{_UP}])[{_SIGN}«»¿¡„“‚]+(?=[{_LOW}{_UP}])", 3.0),
    (f"(?<![\\d.,])[{_SIGN}]+(?=[{_LOW}{_UP}])(?!(?<=µ)[gmlsA-Z])(?!(?<=[€£¥$§©])[A-Z])(?!(?<=°)[CFK])", 2.0),
    ("(?<=[ÂÃâĂÅ])[^\\sA-Za-z\\d.,;:!?)]", 3.0),
    ("(?<![A-ZÀ-Þ])[ÂÃĂ]\xa0", 3.0),
    ("[‚ƒ†‡ˆ‰‹›Ÿ˜¤¦¨¬¯´¸¼½¾þ³¹Þ╗└┬├٠-٩۰-۹]", 1.0),
    (f"[ªº]+(?=[\\s.,;])(?<=[{_LOW}]\\S)", 1.0),
    (_MIXED, 3.0),
    ("(?<=[Ѐ-ӿ])[¢-ª¬-º¼-¿€‚ƒ†‡•‰‹›™](?=[Ѐ-ӿ])", 3.0),
    ("[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї]", 1.5),
    ("(?<=[а-яё])[А-ЯЁ]", 2.0),
    ("(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{2,}", 6.0),
    ("[Ͱ-Ͽ԰-֏߀-߿܀-ࣿƀ-ɏɐ-ͯ҃-҉Ԁ-ԯ]", 2.0),
    ("(?<=[À-ÿ¡-¿]{2})[À-ÿ¡-¿]", 1.0),
    (_RARE_HAN, 2.0),
    ("[þðÞÐÝý]", 0.5),
    ("(?<= )[ÓÚÞÒÊÛ└](?= [a-z])", 2.0),
]
_COST = re.compile("|".join(f"({p})" for p, _ in _EVENTS))
_PRICE = [p for _, p in _EVENTS]
_CJK_PUNCT = re.compile("[　-ヿ一-鿿＀-｠가-힯]")
_LETTERISH = re.compile("[^\x00-\x7f֐-ۿऀ-෿฀-๿Ѐ-ӿ　-ヿ一-鿿가-힯＀-｠]")


_RUN = re.compile("[^\x00-\x7f]+")
# A text that begins with a small letter of its own before a word in capitals: the cases of Cyrillic letters are swapped.
_SWAPPED = re.compile("[а-яё] [А-ЯЁ]{2,}")
# Runs of one script that hold no doubt whatever stands beside them, but for small Latin letters.
_PLAIN = re.compile(f"[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+|[ऀ-ॿ]+|[฀-๿]+|[؀-ٟ٪-ۯۺ-ۿ]+|(?:(?!{_RARE_HAN})[、-〟ぁ-ゖゝ-ヿ一-鿿！-～])+")
_BESIDE = re.compile("[A-Za-z]")


@lru_cache(maxsize=100_000)
def _run_cost(run: str, before: str, after: str) -> tuple[float, float]:
    """Price of the doubts in a run of characters beyond ASCII, and the little that each character counts."""
    base = 0.1 * len(run) + 0.1 * len(_LETTERISH.findall(run))
    if _PLAIN.fullmatch(run) and not _BESIDE.search(before[-1:] + after[:1]):
        return 0.0, base
    return sum(_PRICE[m.lastindex - 1] for m in _COST.finditer(before + run + after)), base


def _costs(text: str) -> tuple[float, float]:
    doubts = base = 0.0
    for m in _RUN.finditer(text):
        i, j = m.span()
        d, b = _run_cost(m[0], text[max(0, i - 2) : i], text[j : j + 2])
        doubts += d
        base += b
    if _escaped(text):
        doubts += 3.0 * len(_ESCAPE.findall(text))
    if _SWAPPED.match(text):
        doubts += 6.0
    return doubts, base


def cost(text: str) -> float:
    """Implausibility of the characters of a text; a character read as two or three costs more than itself."""
    return sum(_costs(text))


def _repair_utf8(name: str, text: str) -> str:
    pattern, code = _UTF8[name]

    def fix(m: re.Match) -> str:
        try:
            c = bytes(code[x] for x in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return c if unicodedata.category(c) not in ("Cn", "Co", "Cs") else m[0]

    return pattern.sub(fix, text)


def _wide_from_latin(name: str, text: str) -> str:
    """Runs of Latin characters whose bytes are text of a wide charset."""

    def fix(m: re.Match) -> str:
        run = m[0]
        if sum(c > "\x7f" for c in run) < 4:
            return run
        try:
            got = bytes(_CP1252[c] for c in run).decode(name)
        except (UnicodeDecodeError, KeyError):
            return run
        return got if 2 * len(_CJK_PUNCT.findall(got)) >= sum(c > "\x7f" for c in got) else run

    return _LATIN_RUN.sub(fix, text)


def _utf8_from_wide(name: str, text: str) -> str:
    """UTF-8 that was read as a wide charset; what that lost stays lost."""
    if not _CJK_PUNCT.search(text):
        return text
    try:
        data = text.replace("�", "").encode(name)
    except UnicodeEncodeError:
        return text
    got = data.decode("utf-8", "replace")
    lost = got.count("�")
    return got if lost * 4 <= len(got) else text


def _unescape(text: str) -> str:
    if not _ESCAPE.search(text):
        return text
    text = html.unescape(text)
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)

    def from_hex(m: re.Match) -> str:
        try:
            return bytes.fromhex(m[0].replace(m[0][0], "")).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return re.sub(r"(?:%[0-9A-F]{2}){2,}|(?:=[0-9A-F]{2}){2,}", from_hex, text)


#: Charsets that only text with Cyrillic or box characters went through.
_CYRILLIC = re.compile("[Ѐ-ӿ─-▟]")
_ACCENTS = re.compile("[À-ÿ¡-¿\x80-\x9f]{2}")


def _operations() -> list[tuple[str, re.Pattern | None, Callable[[str], str]]]:
    """Name, what a text must hold for it to apply, and the operation."""
    east = ("cp1251", "koi8_r", "cp866")
    ops: list[tuple[str, re.Pattern | None, Callable[[str], str]]] = [(f"utf8<{n}", _CYRILLIC if n in east else None, lambda t, n=n: _repair_utf8(n, t)) for n in _WRONG]
    ops.append(("utf8<cp1252 twice", None, lambda t: _repair_utf8("cp1252", _repair_utf8("cp1252", t))))
    for r, w in _SINGLE:
        need = _CYRILLIC if w in east else _ACCENTS if r in (*east, "cp1256", "cp1253") else None
        ops.append((f"{r}<{w}", need, lambda t, k=(r, w): t.translate(_SWAP[k])))
    ops += [(f"{n}<latin", _ACCENTS, lambda t, n=n: _wide_from_latin(n, t)) for n in _WIDE]
    ops += [(f"utf8<{n}", _CJK_PUNCT, lambda t, n=n: _utf8_from_wide(n, t)) for n in _WIDE_WRONG]
    return [*ops, ("unescape", _ESCAPE, _unescape)]


OPERATIONS = _operations()
_BY_NAME = {name: op for name, _, op in OPERATIONS}


def search(text: str, expansions: int | None = -1, depth: int | None = -1, uphill: float | None = -1) -> tuple[str, float, float, tuple[str, ...]]:
    """The cheapest text that operations reach, its cost, the cost of ``text``, and the operations.

    The bounds are those of the module unless given (-1); None lifts one.
    """
    expansions, depth, uphill = (own if given == -1 else given for given, own in ((expansions, EXPANSIONS), (depth, DEPTH), (uphill, UPHILL)))
    start = cost(text)
    best, best_cost, best_path = text, start, ()
    queue: list[tuple[float, int, str, tuple[str, ...]]] = [(start, 0, text, ())]
    seen, serial = {hash(text)}, 0
    taken = 0
    while queue and (expansions is None or taken < expansions):
        taken += 1
        c, _, state, path = heapq.heappop(queue)
        if depth is not None and len(path) >= depth:
            continue
        for name, need, op in OPERATIONS:
            if need and not need.search(state):
                continue
            new = op(state)
            if hash(new) in seen:
                continue
            seen.add(hash(new))
            serial += 1
            # A step costs a little, so that the plain text isn't changed for nothing.
            doubts, base = _costs(new)
            n = doubts + base + 0.5 * (len(path) + 1)
            if n < best_cost:
                best, best_cost, best_path = new, n, (*path, name)
                if not doubts:
                    return best, best_cost, start, best_path
            if uphill is None or n < c + uphill:
                heapq.heappush(queue, (n, serial, new, (*path, name)))
    return best, best_cost, start, best_path


def _reduced(text: str) -> str:
    """The characters beyond ASCII with those beside them; operations on single bytes change nothing else."""
    return "\n".join(text[max(0, m.start() - 2) : m.end() + 2] for m in _RUN.finditer(text))


def _best(text: str) -> tuple[str, float, float, tuple[str, ...]]:
    """``search``; in a text with few characters beyond ASCII on those and what stands beside them.

    What was found there is priced on the whole text; if that leaves doubts or gains less, the whole text is searched.
    """
    if len(text) > 200 and 5 * sum(map(len, _RUN.findall(text))) < len(text) and not _escaped(text):
        path = search(_reduced(text))[3]
        best = text
        for name in path:
            best = _BY_NAME[name](best)
        doubts, base = _costs(best)
        if path and not doubts:
            return best, doubts + base + 0.5 * len(path), cost(text), path
    return search(text)


def _repair(text: str) -> tuple[str, bool]:
    """The text after the best operations, where they gain enough, and whether doubts are left."""
    best, new, old, _ = _best(text)
    if old - new < GAIN:
        return text, True
    return best, _costs(best)[0] > 0


_PASSAGE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？\n]+|$)\s*|[.!?。！？\n]+\s*")
_SURE = re.compile("[\x80-\x9f�]")


def _escaped(text: str) -> bool:
    return ("&" in text or "\\u" in text or "%" in text or "=" in text) and bool(_ESCAPE.search(text))


# Texts in which no doubt is possible, told faster than by their runs.
_LATIN = re.compile("[\x00-\x7fßàáä-ïñ-öù-üœ‘’”–—…É]*")
_TRIPLE = re.compile("[À-ÿ]{3}|[a-zß-ÿ]É")
_COMMON_HAN = "".join(chr(c) for c in range(0x4E00, 0xA000) if _common(chr(c)))
_OTHER = re.compile(f"[\x00-\x7f‘’“”–—…؀-ٟ٪-ۯۺ-ۿऀ-ॿ฀-๿、-〟ぁ-ゖゝ-ヿ！-～{_COMMON_HAN}]*")
_TOUCHES = re.compile("[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]")


def _doubtful(text: str) -> bool:
    if text.isascii():
        return _escaped(text)
    if _LATIN.fullmatch(text) and not _TRIPLE.search(text) or _OTHER.fullmatch(text) and not _TOUCHES.search(text):
        return _escaped(text)
    return _costs(text)[0] > 0 or _escaped(text)


def restore(text: str) -> tuple[bool, str]:
    """Whether a passage of the text was decoded wrongly, and the text as it was meant as far as can be told."""
    if not _doubtful(text):
        return False, text
    best, doubts = _repair(text)
    if doubts:
        # Passages of a text may have gone through different hands.
        for whole in dict.fromkeys((best, text)):
            parts = "".join(_repair(p)[0] if _doubtful(p) else p for p in _PASSAGE.findall(whole))
            if cost(parts) < cost(best):
                best = parts
    return best != text or bool(_SURE.search(text)), best


def find_garbled(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, field_name, text, restored for each field with a wrongly decoded passage."""
    parts = None
    for f in fields:
        own = df.select(F.col(key), F.lit(f).alias("field_name"), F.col(f).alias("text"))
        parts = own if parts is None else parts.unionByName(own)
    # Pure ASCII without escapes can't be garbled; the JVM keeps it from Python.
    asked = parts.where((F.length("text") != F.octet_length("text")) | F.col("text").rlike(r"&#?\w{2,8};|\\u[0-9a-fA-F]{4}|(?:[%=][0-9A-F]{2}){2}"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([restore(t) for t in s], columns=["garbled", "restored"])

    got = asked.withColumn("r", F.pandas_udf(run, "garbled boolean, restored string")("text"))
    return got.where("r.garbled").select(key, "field_name", "text", F.col("r.restored").alias("restored"))


def _decoded(origin: list[tuple[int, bytes]], right: str, errors: str) -> tuple[str, list[int]]:
    """Characters of ``right`` from bytes with the place that each byte came from."""
    decoder = codecs.getincrementaldecoder(right)(errors)
    out, places, since = [], [], None
    for at, data in origin:
        for k in range(len(data)):
            since = at if since is None else since
            if got := decoder.decode(data[k : k + 1]):
                out.append(got)
                places += [since] * len(got)
                since = None
    return "".join(out), places


def _aligned(name: str, text: str) -> list[int]:
    """The place in ``text`` of each character of the operation's result, and the end."""
    new = _BY_NAME[name](text)
    if len(new) == len(text):
        return list(range(len(text) + 1))
    places: list[int] = []
    if name == "utf8<cp1252 twice":
        first = _aligned("utf8<cp1252", text)
        return [first[p] for p in _aligned("utf8<cp1252", _repair_utf8("cp1252", text))]
    if name == "unescape":
        return _by_length(text, new)
    right, wrong = name.split("<")
    if wrong in _UTF8 and right == "utf8":
        at = 0
        for m in _UTF8[wrong][0].finditer(text):
            one = _repair_utf8(wrong, m[0])
            places += range(at, m.start())
            places += [m.start()] * len(one) if one != m[0] else range(m.start(), m.end())
            at = m.end()
        places += range(at, len(text))
    elif wrong == "latin":
        at = 0
        for m in _LATIN_RUN.finditer(text):
            one = _wide_from_latin(right, m[0])
            places += range(at, m.start())
            if one != m[0]:
                places += [m.start() + p for p in _decoded([(k, bytes([_CP1252[c]])) for k, c in enumerate(m[0])], right, "strict")[1]]
            else:
                places += range(m.start(), m.end())
            at = m.end()
        places += range(at, len(text))
    else:
        places = _decoded([(k, c.encode(wrong)) for k, c in enumerate(text) if c != "�"], "utf-8", "replace")[1]
    return [*places, len(text)] if len(places) == len(new) else _by_length(text, new)


def _by_length(text: str, new: str) -> list[int]:
    return [k * len(text) // max(1, len(new)) for k in range(len(new))] + [len(text)]


def _repair_aligned(text: str) -> tuple[str, list[int] | None]:
    _, new, old, path = _best(text)
    if old - new < GAIN:
        return text, None
    places = list(range(len(text) + 1))
    for name in path:
        places = [places[p] for p in _aligned(name, text)]
        text = _BY_NAME[name](text)
    return text, places


def restore_aligned(text: str) -> tuple[str, list[int] | None]:
    """The text as ``restore`` gives it, and the place in ``text`` of each of its characters and of its end.

    The places are None where nothing was restored.
    """
    if not _doubtful(text):
        return text, None
    best, places = _repair_aligned(text)
    options = [(best, places)]
    if places is None or _costs(best)[0] > 0:
        out, at, places = [], 0, []
        for p in _PASSAGE.findall(text):
            one, own = _repair_aligned(p) if _doubtful(p) else (p, None)
            out.append(one)
            places += [at + k for k in (own[:-1] if own else range(len(p)))]
            at += len(p)
        options.append(("".join(out), [*places, len(text)]))
    best, places = min(options, key=lambda o: cost(o[0]))
    return (text, None) if best == text else (best, places)
