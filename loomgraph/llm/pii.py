"""Personal information inside free text.

Method: offset-preserving deobfuscation. A transducer rewrites a text character by character and remembers for each character
of the result the source position it stems from: homoglyphs, full-width forms and exotic spaces become plain characters,
zero-width characters vanish, spelled digits become digits, and disguised at-signs and dots of addresses become `@` and `.`.
Identifiers are detected on the normalised text, and their spans are mapped back to the source, where typed placeholders
replace them; all else stays as it is.

Names are recognised by shape: a character model tells tokens of personal names from ordinary words. It is fitted on the
(fixed, bounded) contributors table against the ordinary words of a public vocabulary, so that people who are no contributors
are found too; a name needs a family name with a given name or initials.

Defined results: null and empty texts hold nothing and stay as they are; whole texts are read, however long; rows given again
give the same spans and count once by id; a row with a null id is skipped by `find`; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.resources import TOKENIZERS, ordinary_words

# Letters of other scripts that look like Latin ones, and words for digits.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαοινΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaoivABEZHIKMNOPTYX", strict=True))
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
ZERO_WIDTH = "​‌‍⁠﻿­"
#: A contributors table beyond this is refused: the name model is fitted on the driver.
MAX_CONTRIBUTORS = 200_000


class Folded:
    """A normalised text with the source position of each character (one more for the end)."""

    __slots__ = ("text", "at")

    def __init__(self, text: str, at: list[int] | None):
        self.text, self.at = text, at

    def source(self, i: int) -> int:
        return i if self.at is None else self.at[i]

    def edit(self, edits: Iterable[tuple[int, int, str]]) -> Folded:
        """Replace spans (in order, not overlapping); each new character stems from the start of its span."""
        out, at, done = [], [], 0
        src = self.at if self.at is not None else range(len(self.text) + 1)
        for a, b, new in edits:
            out.append(self.text[done:a])
            at.extend(src[done:a])
            out.append(new)
            at.extend([src[a]] * len(new))
            done = b
        if not out:
            return self
        out.append(self.text[done:])
        at.extend(src[done:])
        return Folded("".join(out), at)


_ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏẞ]")
_SPELLED = re.compile(r"\b(?:%s)(?:[ \-.,]+(?:%s)){4,}\b" % (("|".join(DIGIT_WORDS),) * 2), re.I)
_LABEL = r"[^\W_](?:[\w\-]*[^\W_])?"
_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|<at>|&#64;|&#x40;|&commat;|%40)\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|&#46;|&period;)\s?)"
_SPOKEN = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s+dot\s+)"
_LOCAL = r"[\w](?:[\w.+\-]*[\w])?"
_DISGUISED = re.compile(rf"({_LOCAL})({_AT}|\s+at\s+)({_LABEL}(?:{_SPOKEN}{_LABEL})+)", re.I)
_SPELLED_AT = ("(at)", "[at]", "{at}", "<at>", "&#64;", "&#x40;", "&commat;", "%40")
_SPACED_AT = re.compile(r"\s@|@\s")
_PLAIN_AT = re.compile(r"\s+at\s+", re.I)
_SPELLED_DOT = re.compile(r"\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s+dot\s+", re.I)


def _fold_char(c: str) -> str:
    if c in ZERO_WIDTH:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c.isspace():
        return " "
    n = unicodedata.normalize("NFKC", c)
    if unicodedata.category(c) == "Pd" or c == "−":
        return "-"
    return n if n.isascii() else c


def fold(text: str) -> Folded:
    """The transducers, one after the other."""
    f = Folded(text, None)
    edits = [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _fold_char(m.group())) != m.group()]
    f = f.edit(edits)
    low = f.text.lower()
    if sum(map(low.count, DIGIT_WORDS)) >= 5:
        f = f.edit([(m.start(), m.end(), "".join(DIGIT_WORDS[w] for w in re.findall(r"[a-z]+", m.group().lower()))) for m in _SPELLED.finditer(f.text)])
        low = f.text.lower()
    edits = []
    if any(x in low for x in _SPELLED_AT) or ("dot" in low and ("@" in low or "at" in low)) or ("@" in low and _SPACED_AT.search(low)):  # nothing else is rewritten below
        for m in _DISGUISED.finditer(f.text):
            at, host = m.group(2), m.group(3)
            dots = list(_SPELLED_DOT.finditer(host))
            if _PLAIN_AT.fullmatch(at) and not dots:
                continue
            if at != "@":
                edits.append((m.start(2), m.end(2), "@"))
            edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in dots]
    return f.edit(edits)


_EMAIL = re.compile(rf"(?<![\w.+\-]){_LOCAL}@{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}(?![\w@]|\.\w|-\w|:[\w.\-]+/)")
_PHONE = re.compile(
    r"""(?<![\w.\-/+])(?:
    \+\d{1,3}(?:[ .\-/]?(?:\(\d{1,5}\)|\d{2,5})){2,6}(?<=\d{3})
    | 00[ \-]?[1-9]\d{0,2}(?:[ .\-/](?:\(\d{1,5}\)|\d{2,5})){2,5}(?<=\d{3})
    | \(0\d{1,4}\)[ \-/]?\d{2,4}(?:[ \-]?\d{2,5}){1,3}
    | 0\d{1,4}[ /\-]\d{2,4}(?:[ \-]?\d{2,5}){1,3}(?<=\d{3})
    | 0\d{4}[ \-/]\d{6}
    | 0[1-9]\d{8,9}
    | \(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}
    | (?:1[ .\-])?\d{3}([.\- ])\d{3}\1\d{4}
    | 55\d(?:\d{7})?(?!\d)(?<=\d{10})
    )(?!\w|[.\-]\d)""",
    re.X,
)
_PHONE_CUE = re.compile(r"(?:tel|phone|call|fax|sms|mobile|callback|number)\W{0,4}(?:\w+\W{1,3}){0,2}$", re.I)
_BARE_PHONE = re.compile(r"(?<![\w.\-/+])[2-9]\d{9}(?![\w.\-])")
_ID = re.compile(
    r"""(?<![\w\-.])(?:
    \d{3}-\d{2}-\d{4}
    | \d{3}[ ]\d{2}[ ]\d{4}
    | [A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]
    | [A-Z]{2}\d{2}-\d{4}-\d{3}
    | [A-Z]{1,2}\d{7,8}
    | \d{6}-\d{4}
    | \d{2}-\d{7}
    | \d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}
    )(?![\w]|[\-.]\d)""",
    re.X,
)
_ID_LABEL = re.compile(
    r"""(?<![^\W_])(?:ssn|social[ ]security|passport|driv(?:er'?s?|ing)[ ]licen[cs]e|licen[cs]e|tax[ ]id|taxpayer[ ]id|steuer-?id(?:nr)?|steuernummer|nino|ni[ ]number
    |national[ ]insurance|national[ ]id|insurance|personal[ ](?:number|id)|personnummer|id[ ]card|identity[ ](?:card|number)|tin|itin|ein)
    (?:[ ](?:no\.?|number|nr\.?|id|\#))?[ ]?["']?[ ]?[:=\#]?[ ]?["']?
    ((?-i:[A-Z]{0,3})[ \-]?\d(?:[ \-./]?\d){4,14}(?:[ \-]?(?-i:[A-Z])(?!\w))?(?!\d))""",
    re.X | re.I,
)
# Kinds of streets, as words after or before a street's name.
STREET_AFTER = "street st avenue ave road rd lane ln drive dr court ct terrace ter boulevard blvd way place pl square sq close crescent parkway pkwy row walk alley circle".split()
STREET_BEFORE = "rue|calle|via|avenida|avenue|boulevard|rua|chemin|plaza|piazza|impasse|quai|camino"
STREET_END = "straße|strasse|str\\.|weg|gasse|allee|platz|ufer|damm"
DIRECTIONS = "north|south|east|west|old|upper|lower|new|great|little|n\\.?|s\\.?|e\\.?|w\\.?|ne|nw|se|sw"
_U = r"[^\W\d_]"
_ADDRESS = re.compile(
    rf"""(?<![\w.\-/:])(?:
    (?P<a>\d{{1,5}}[ ]?[a-z]?)[ ](?:(?:{DIRECTIONS})[ ])?(?P<base>(?-i:[^\W\d_a-zß-ÿ]){_U}+(?:[\-' ](?-i:[^\W\d_a-zß-ÿ]){_U}+)?)[ ](?P<type>{"|".join(STREET_AFTER)})(?![\w])
    | (?P<b>\d{{1,5}}[ ]?(?:[a-z]|bis|ter)?),?[ ](?:{STREET_BEFORE})[ ](?:(?:de|du|des|la|le|les|del|los|las|d'|l')[ ]?)*(?-i:[^\W\d_a-zß-ÿ])[\w'\-]*
    | (?:{STREET_BEFORE})[ ](?:(?:de|du|des|la|le|les|del|los|las|d'|l')[ ]?)*(?-i:[^\W\d_a-zß-ÿ])[\w'\-]*,?[ ]\d{{1,5}}(?:[ ]?[a-z])?(?!\w)
    | (?-i:[^\W\d_a-zß-ÿ])[^\W\d_\-]*(?:-{_U}+)*(?:[ \-])?(?:{STREET_END})[ ]\d{{1,4}}(?:[ ]?[a-z])?(?![\w.]\w|\w)
    )""",
    re.X | re.I,
)
# Words of this field that come before "Road", "Lane", "Court" in names of products and documents.
SOFTWARE = set("parser worker error session server client graph request response query index cursor cache build test release process thread memory data code log event node edge flow sprint swim fast slow main retry order service design product network token user task job feature bug review".split())
_AFTER_STREET = re.compile(r"[ ](?:Map|Maps|Case|Cases|Test|Tests|Sign|Show)\b|[ ](?!(?:in|on|at|and|or|to|is|was|are|were|from|for|as|by|with|has|had|now|near|please|before|after|but|that|where|when|which|will|must|should|can)\b)[a-z]{3,}")


class NameModel:
    """Tells tokens of personal names from ordinary words by the log-odds of their character trigrams."""

    def __init__(self, names: Iterable[str], words: Iterable[str]):
        tokens = defaultdict(int)
        for n in names:
            for t in re.findall(r"[^\W\d_]+", n.lower()):
                if len(t) > 2 and t not in PARTICLES:
                    tokens[t] = 1
        self.known = frozenset(tokens)
        self.words = frozenset(w for w in words if w not in tokens)
        pos, neg = self._counts(tokens), self._counts(self.words)
        np_, nn = sum(pos.values()) or 1, sum(neg.values()) or 1
        grams = set(pos) | set(neg)
        v = len(grams) + 1
        self.odds = {g: math.log((pos.get(g, 0) + 0.05) / (np_ + 0.05 * v)) - math.log((neg.get(g, 0) + 0.5) / (nn + 0.5 * v)) for g in grams}
        self.unseen = -1.0
        self.cache: dict[str, float] = {}
        self.begins: dict[str, bool] = {}

    @staticmethod
    def _counts(tokens: Iterable[str]) -> dict[str, int]:
        out: dict[str, int] = defaultdict(int)
        for t in tokens:
            for g in NameModel._grams(t):
                out[g] += 1
        return out

    @staticmethod
    def _grams(t: str) -> list[str]:
        s = f"^{t}$"
        return [s[i : i + 3] for i in range(len(s) - 2)]

    def may_begin(self, word: str) -> bool:
        """Whether a name can begin with a token: an initial, a particle, or what looks like a name."""
        ok = len(word) == 1 or self.score(word) > 0 or word.lower() in PARTICLES
        if len(self.begins) < 200_000:
            self.begins[word] = ok
        return ok

    def score(self, token: str) -> float:
        """Mean log-odds of a token; above 0 it looks like a name."""
        t = token.lower()
        s = self.cache.get(t)
        if s is None:
            if t in self.known:
                s = 9.0
            elif t in self.words or len(t) < 3:
                s = -9.0
            else:
                g = self._grams(t)
                s = sum(self.odds.get(x, self.unseen) for x in g) / len(g)
            if len(self.cache) < 200_000:
                self.cache[t] = s
        return s


# Words between given and family names.
PARTICLES = {"van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "al", "el", "ben", "bin", "ter", "ten", "st"}
_PART = r"(?:(?:van|von|de|del|della|di|da|du|la|le|ter|ten|bin|ben)[ ](?:(?:der|den|la|los)[ ])?|(?:al|el)-|O'|d')"
_WORD = rf"{_U}{{3,}}"
_FAM = rf"{_PART}?{_WORD}(?:-{_WORD})?"
def _familyish(model: NameModel, fam: str) -> float:
    body = re.sub(rf"^{_PART}", "", fam, flags=re.I)
    return min(model.score(t) for t in body.split("-"))


_TOKEN = re.compile(r"[^\W\d_]+")


def find_names(text: str, model: NameModel, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of personal names outside the spans already taken. A name can only begin with a token that looks like a name, a particle or an initial."""
    out: list[tuple[int, int]] = []
    pos, n = 0, len(text)
    hide = bytearray(n)
    for a, b in taken:
        hide[a:b] = b"\x01" * (b - a)
    begins = model.begins
    for m in _TOKEN.finditer(text):
        word = m.group()
        ok = begins.get(word)
        if ok is None:
            ok = model.may_begin(word)
        if not ok:
            continue
        a = m.start()
        if a < pos or hide[a]:
            continue
        if len(word) == 1 and text[a + 1 : a + 2] != ".":
            continue
        if a and (text[a - 1] in "@.-_" or text[a - 1].isdigit()):
            continue
        end = _judge(text, a, model)
        if end and not any(hide[a:end]) and not (end < n and (text[end].isalnum() or text[end] in "@_")):
            out.append((a, end))
            pos = end
    return out


_N1 = re.compile(rf"(?P<g>{_WORD}(?:-{_WORD})?)[ ](?:{_U}\.[ ]?){{0,2}}(?P<f>{_FAM})(?!\w)", re.I)
_N2 = re.compile(rf"(?P<f>{_FAM}),[ ]?(?P<g>{_WORD}(?!\w)|(?:{_U}\.[ ]?){{1,3}}(?<=\.))", re.I)
_N3 = re.compile(rf"(?:{_U}\.[ \-]?){{1,3}}(?P<f>{_FAM})(?!\w)", re.I)


def _judge(text: str, a: int, model: NameModel) -> int | None:
    m = _N3.match(text, a)
    if m and m.group("f")[0] != "." and _familyish(model, m.group("f")) > 0.3:
        return m.end()
    m = _N1.match(text, a)
    if m and m.group("g").lower() not in PARTICLES:
        g, f = min(model.score(t) for t in m.group("g").split("-")), _familyish(model, m.group("f"))
        if g > 0 and f > 0:
            return m.end()
    m = _N2.match(text, a)
    if m:
        f, g = _familyish(model, m.group("f")), m.group("g")
        gs = 1.0 if "." in g else model.score(g)
        if f > 0 and gs > 0:
            return m.end() if "." not in g else a + len(m.group().rstrip())
    return None


_DIGIT = re.compile(r"\d")


def find(text: str, model: NameModel) -> list[tuple[str, int, int]]:
    """(type, start, end) of each personal value in a text, in source positions and in order; longer kinds win over their parts."""
    if not text:
        return []
    f = fold(text)
    t, spans = f.text, []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def take(kind: str, a: int, b: int) -> None:
        if free(a, b):
            taken.append((a, b))
            spans.append((kind, a, b))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            if not re.match(r"git@", m.group(), re.I) or t[m.end() : m.end() + 1] not in (":", "/"):
                take("email", *m.span())
    digits = len(_DIGIT.findall(t))
    if digits:
        for m in _ADDRESS.finditer(t):
            base = m.group("base")
            if base and (base.split()[0].lower() in SOFTWARE or _AFTER_STREET.match(t, m.end())):
                continue
            take("address", *m.span())
    if digits >= 6:  # no number below has fewer
        for m in _ID_LABEL.finditer(t):
            if sum(c.isdigit() for c in m.group(1)) >= 6:
                take("id_number", *m.span(1))
        for m in _ID.finditer(t):
            take("id_number", *m.span())
        for m in _PHONE.finditer(t):
            if 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                take("phone", *m.span())
        for m in _BARE_PHONE.finditer(t) if digits >= 10 else ():
            if _PHONE_CUE.search(t, max(0, m.start() - 40), m.start()):
                take("phone", *m.span())
    for a, b in find_names(t, model, taken):
        take("name", a, b)
    return sorted(((k, f.source(a), f.source(b)) for k, a, b in spans), key=lambda x: x[1])


def redact(text: str | None, model: NameModel) -> str | None:
    """The text with typed placeholders in place of personal values."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b in find(text, model):
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join(out) + text[done:]


def fit_names(contributors: DataFrame, tokenizer_dir: str = TOKENIZERS) -> NameModel:
    """The name model of a store. The contributors table is fixed; more than MAX_CONTRIBUTORS rows are refused."""
    names = [r[0] for r in contributors.select("display_name").where("display_name is not null").distinct().limit(MAX_CONTRIBUTORS + 1).collect()]
    if len(names) > MAX_CONTRIBUTORS:
        raise ValueError("too many contributors to fit a name model on the driver")
    return NameModel(names, ordinary_words(tokenizer_dir))


FOUND = T.StructType([T.StructField("id", T.StringType()), T.StructField("field", T.StringType()), T.StructField("pii_type", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])


def find_all(observations: DataFrame, model: NameModel, fields: tuple[str, ...] = ("title", "body"), key: str = "id") -> DataFrame:
    """(id, field, pii_type, start_pos, end_pos) of every personal value; each id counts once: equal values of rows given again are dropped, not their texts. An id given with several texts has the values of each."""
    spark = observations.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a few thousand trigrams, bounded by MAX_CONTRIBUTORS and the vocabulary
    rows = observations.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *fields)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, name, kind, s, e) for name in fields for i, text in zip(b["id"], b[name]) if isinstance(text, str) and text for kind, s, e in find(text, shared.value)]
            yield pd.DataFrame(out, columns=FOUND.names)

    return rows.mapInPandas(search, FOUND).distinct()


def redact_all(observations: DataFrame, model: NameModel, fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """All rows and columns, the fields with placeholders."""
    shared = observations.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def clean(s: pd.Series) -> pd.Series:
        return s.map(lambda x: redact(x, shared.value) if isinstance(x, str) else x)

    return observations.withColumns({f: clean(F.col(f)) for f in fields})
