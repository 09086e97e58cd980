"""Personal data, also in disguise: a transducer rewrites disguises and keeps, for each character it writes, the span that it read."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches as the pattern's, tried once for each run of digits.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝвкмнтАВЕКМНОРСТУХІЈЅαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwbkmhtABEKMHOPCTYXIJSaopvikABEZHIKMNOPTYX", strict=True))
# Digits in words, English, French, Spanish, German.
DIGIT_WORDS = {
    w: str(d)
    for d, words in enumerate((
        "zero oh zéro cero null", "one un une uno eins", "two deux dos zwei", "three trois tres drei", "four quatre cuatro vier",
        "five cinq cinco fünf", "six seis sechs", "seven sept siete sieben", "eight huit ocho acht", "nine neuf nueve neun",
    ))
    for w in words.split()
}
# How the two signs of an address are read out, and what announces an address.
AT_WORDS, DOT_WORDS = "at|arobase|arroba", "dot|point|punto|punkt"
CUES = re.compile(r"(?<!\w)(?:e-?mails?|mail(?:to|ed)?|contact|contacto|contacter|write|reach|courriel|correo|adresse|address|schreib\w*|escrib\w*|écri\w*)(?!\w)", re.I)
#: Characters before a disguise of plain words within which a cue must stand.
CUE_REACH = 40
INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD], "")
FULL_WIDTH = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
#: Decimal digits of every script, by their value.
DIGITS = {c: str(v) for c in range(0x80, 0x20000) if (v := unicodedata.decimal(chr(c), None)) is not None}
SINGLE = {ord(k): v for k, v in LOOKALIKES.items()} | FULL_WIDTH | DIGITS | INVISIBLE
MAPPED = re.compile("[" + "".join(map(re.escape, map(chr, SINGLE))) + "]")

_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_AT, _DOT = rf"(?:\s*[\[({{<]\s*(?:{AT_WORDS}|@)\s*[\])}}>]\s*|\s+(?:{AT_WORDS})\s+)", rf"(?:\s*[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*|\s+(?:{DOT_WORDS})\s+)"
DISGUISED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_DOT}[A-Za-z0-9_%+-]{{1,64}}){{0,3}}(?:{_AT}|\s*@\s*)[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
#: At least this many digits in words in a row are rewritten even if no base span comes of it.
LEAST_SPELLED = 8
_TOKEN = rf"(?:[0-9]+|{_WORD})(?!\w)"
_GAP = rf"(?>{_DOT}|[ ,.()-]+)"
#: Digits and digits in words, in any mixture.
RUN = re.compile(rf"(?<!\w)(?>(?:plus[ ,.-]+|\+ *)?)(?>{_TOKEN}(?:{_GAP}{_TOKEN})*)", re.I)
PLUS, TOKEN = re.compile(r"plus[ ,.-]+|\+ *", re.I), re.compile(_TOKEN, re.I)
SPELLED = re.compile(rf"(?<!\w)(?:plus[ ,.-]+)?(?:(?:{_WORD})[ ,.-]+){{{LEAST_SPELLED - 1},}}(?:{_WORD})(?!\w)", re.I)
#: Two numbers in a row of which one is a word, or a dot in disguise between two.
RUN_HINT = rf"(?<!\w)(?:{_WORD}){_GAP}(?:[0-9]|(?:{_WORD})(?!\w))|[0-9]{_GAP}(?:{_WORD})(?!\w)|[0-9]{_DOT}[0-9]"
# Lower case is searched as it stands, which is faster than without regard to case.
RUN_HINT, LOW_RUN_HINT = re.compile(RUN_HINT, re.I), re.compile(RUN_HINT)
STOP = re.compile(r"[,.()]")
AT, DOT = re.compile(_AT + r"|\s*@\s*", re.I), re.compile(_DOT, re.I)
HINT = re.compile(rf"[\[({{<]\s*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s*[\])}}>]|\s(?:{DOT_WORDS})\s")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    digits = re.sub("[^0-9]", "", text)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def find(text: str) -> list[tuple[str, int, int]]:
    """The base spans (kind, start, end), by kind and start: leftmost matches without overlap, those that fail dropped."""
    out = []
    has_at, digit = "@" in text, re.search("[0-9]", text)
    if has_at:
        # Where a run of name characters ends in @, the match can only begin in that run: nothing else is scanned.
        last = 0
        for at in re.finditer("@", text):
            if at.start() < last:
                continue
            begin = at.start()
            while begin > last and (c := text[begin - 1]).isascii() and (c.isalnum() or c in "._%+-"):
                begin -= 1
            if m := PATTERNS["email"].match(text, begin):
                out.append(("email", m.start(), m.end()))
                last = m.end()
    if digit:
        for kind, pattern in (("ip", IP), ("card", PATTERNS["card"])):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text, digit.start()) if valid(kind, m[0])]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PATTERNS["phone"].finditer(text) if valid("phone", m[0])]
    return out


class Transduced:
    """A text being rewritten; lo[i] and hi[i] bound the span of the original that character i comes from."""

    def __init__(self, text: str):
        self.text = text
        self.lo = self.hi = None  # until something is rewritten, each character stands for itself

    @property
    def changed(self) -> bool:
        return self.lo is not None

    def span(self, i: int, j: int) -> tuple[int, int]:
        return (i, j) if self.lo is None else (int(self.lo[i]), int(self.hi[j - 1]))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts the strings in place of the spans, which come in order and don't overlap; each new character stands for all of its span."""
        if not edits:
            return
        lo, hi = (np.arange(len(self.text)), np.arange(1, len(self.text) + 1)) if self.lo is None else (self.lo, self.hi)
        out, los, his, at = [], [], [], 0
        for i, j, new in edits:
            out += [self.text[at:i], new]
            los += [lo[at:i], np.full(len(new), lo[i])]
            his += [hi[at:i], np.full(len(new), hi[j - 1])]
            at = j
        out.append(self.text[at:])
        self.lo, self.hi = np.concatenate([*los, lo[at:]]), np.concatenate([*his, hi[at:]])
        self.text = "".join(out)


def _spell(text: str, start: int, end: int, dots: bool) -> list[tuple[int, int, str]]:
    """Edits that write the run [start, end) in digits. dots: dots between numbers stay, else they go."""
    edits, last, spelled = [], start, False
    if m := PLUS.match(text, start, end):
        edits.append((start, m.end(), "+"))
        last = m.end()
    for m in TOKEN.finditer(text, last, end):
        word = not m[0].isdigit()
        if m.start() > last:
            gap = text[last : m.start()]
            if DOT.fullmatch(gap) or gap == "." and (dots or not (word or spelled)):
                new = "." if dots or gap == "." else ""
            else:
                new = "" if word and spelled else " " if word or spelled else gap
            if new != gap:
                edits.append((last, m.start(), new))
        if word:
            edits.append((m.start(), m.end(), DIGIT_WORDS[m[0].lower()]))
        last, spelled = m.end(), word
    return edits


def _covered(text: str, start: int, end: int, edits: list[tuple[int, int, str]]) -> tuple[int, bool]:
    """Of what edits make of [start, end): the digits in base spans, and whether one is an address."""
    out, at = [], start
    for i, j, new in edits:
        out += [text[at:i], new]
        at = j
    made = "".join(out) + text[at:end]
    spans = find(made)
    return len({c for _, i, j in spans for c in range(i, j) if made[c].isdigit()}), any(k == "ip" for k, _, _ in spans)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """The run without a single digit word that stands after, or before, a number in digits and blanks or commas: it is an article or the like."""
    found = list(TOKEN.finditer(text, start, end))
    if m := PLUS.match(text, start, end):
        found = [t for t in found if t.start() >= m.end()]
    lone = lambda word, number, gap: not word[0].isdigit() and number[0].isdigit() and not DOT.fullmatch(gap)
    if len(found) > 1 and lone(found[-1], found[-2], text[found[-2].end() : found[-1].start()]):
        end = found.pop(-2).end()
    if len(found) > 1 and found[0].start() == start and lone(found[0], found[1], text[found[0].end() : found[1].start()]):
        start = found[1].start()
    return start, end


def _numbers(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Edits of a run of digits, digits in words and dots: of the readings as one number, as an address, as the parts between
    stops, and of long spelled parts alone, that with most digits in base spans."""
    start, end = _trimmed(text, start, end)
    if not RUN_HINT.search(text, start, end):
        return []
    spelled = [e for p in SPELLED.finditer(text, start, end) for e in _spell(text, p.start(), p.end(), False)]
    readings = [_spell(text, start, end, False), _spell(text, start, end, True)]
    cuts = [m.start() for m in STOP.finditer(text, start, end)]
    if cuts:
        parts = [p for i, j in zip([start, *cuts], [*cuts, end], strict=True) if (p := RUN.search(text, i, j))]
        readings.append([e for p in parts for e in _numbers(text, p.start(), p.end())])
    return max([spelled, *readings], key=lambda r: _covered(text, start, end, r))


def _latin(text: str) -> bool:
    """Whether no character can be one that stands for another: those of Latin-1 but the soft hyphen can't."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\xad" not in text


def deobfuscate(text: str) -> Transduced:
    """Look-alike letters and digits, then digits in words, alone or among digits, then at and dot in disguise, become what they stand for."""
    t = Transduced(text)
    if not _latin(text):
        t.rewrite([(m.start(), m.end(), SINGLE[ord(m[0])]) for m in MAPPED.finditer(text)])
    edits = []
    for m in RUN.finditer(t.text) if LOW_RUN_HINT.search(t.text.lower()) else ():
        edits += _numbers(t.text, m.start(), m.end())
    t.rewrite(edits)
    if HINT.search(t.text.lower()) or "@" in t.text and re.search(r"\s@|@\s", t.text):
        edits = []
        for m in DISGUISED.finditer(t.text):
            own = sorted([(a.start(), a.end(), "@") for a in AT.finditer(t.text, m.start(), m.end())][:1] + [(d.start(), d.end(), ".") for d in DOT.finditer(t.text, m.start(), m.end())])
            if all(t.text[i:j].strip().isalpha() for i, j, _ in own):
                # Plain words alone, as prose has them too, are a disguise only with a read-out dot after a cue.
                if not any(s == "." for _, _, s in own) or not CUES.search(t.text, max(0, m.start() - CUE_REACH), m.start()):
                    continue
            edits += own
        t.rewrite(edits)
    return t


def detect(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, both by kind as listed and then by start.

    An added span lies in no other span, but may hold or overlap one: a disguise often leaves a shorter base match.
    """
    if not text:
        return [], []
    base = find(text)
    t = deobfuscate(text)
    every = list(base)
    if t.changed:
        added = [(kind, *t.span(i, j)) for kind, i, j in find(t.text)]
        reach = -1
        for own, span in sorted([(0, s) for s in base] + [(1, s) for s in added], key=lambda x: (x[1][1], -x[1][2], x[0])):
            if own and span[2] > reach:
                every.append(span)
            reach = max(reach, span[2])
        every.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return base, every


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, named by the first and longest."""
    if not text:
        return text
    out, at = [], 0
    for kind, i, j in sorted(detect(text)[1], key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"[{kind.upper()}]"]
            at = j
        elif j > at:
            at = j
    return "".join(out) + text[at:] if out else text


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [detect(t) for t in b.column(1).to_pylist()]
        cols = [b.column(0)]
        cols += [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        cols.append(pa.array([hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in found]))
        cols.append(pa.array([_join(every) for _, every in found]))
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row.

    The counts and the digest are those of the base patterns; spans (kind:start:end in code points, comma-joined) also
    holds what deobfuscation adds. Cases: null or empty text has no spans; spans of different kinds may overlap in the
    base; very long texts are scanned whole, in time that grows with the text and its spans; ties of spans are kept once;
    rows that repeat, and null ids, are scanned each; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([redact(t) for t in b.column(place).to_pylist()], pa.string())
            yield b.set_column(place, b.schema.field(place).name, texts)

    return run


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every detected span replaced by its kind; all other columns as they are, whatever their names. A null text
    stays null, an empty one empty; each row is rewritten by itself, so repeated rows and ids and null ids are no matter;
    very long texts are rewritten whole; an empty table gives an empty result."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return docs.mapInArrow(_redact(docs.columns.index(text_col)), docs.schema)


#: DuckDB SQL of the same result for texts without disguises. The next match begins where its text next occurs, as an
#: earlier occurrence would have been matched.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, text, 1 AS o, 'email' AS k, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS f FROM t
  UNION ALL SELECT doc_id, text, 2, 'ip', regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') FROM t
  UNION ALL SELECT doc_id, text, 3, 'card', regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+') FROM t
  UNION ALL SELECT doc_id, text, 4, 'phone', regexp_extract_all(text, '\+[0-9][ ().0-9-]+[0-9]') FROM t),
p AS (
  SELECT doc_id, o, 0 AS i, 0::BIGINT AS b, 0::BIGINT AS e FROM m
  UNION ALL
  SELECT doc_id, o, i + 1, e + strpos(substr(text, e + 1), f[i + 1]) - 1, e + strpos(substr(text, e + 1), f[i + 1]) - 1 + length(f[i + 1]) FROM p JOIN m USING (doc_id, o) WHERE i < len(f)),
x AS (SELECT doc_id, o, k, b, e, f[i] AS s, regexp_replace(f[i], '[^0-9]', '', 'g') AS d FROM p JOIN m USING (doc_id, o) WHERE i > 0),
g AS (
  SELECT * FROM x WHERE CASE k
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda q: length(ltrim(q, '0')) > 3 OR coalesce(try_cast(nullif(ltrim(q, '0'), '') AS INTEGER), 0) > 255)) = 0
    WHEN 'card' THEN length(d) BETWEEN 16 AND 19
      AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN j % 2 = 1 THEN substr(reverse(d), j, 1)::INTEGER ELSE substr(reverse(d), j, 1)::INTEGER * 2 - CASE WHEN substr(reverse(d), j, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(d) BETWEEN 8 AND 15 END),
a AS (SELECT doc_id, string_agg(k || ':' || b || ':' || e, ',' ORDER BY o, b) AS spans, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o = 3) AS n3, count(*) FILTER (o = 4) AS n4 FROM g GROUP BY doc_id)
SELECT t.doc_id, coalesce(n1, 0) AS n_email, coalesce(n2, 0) AS n_ip, coalesce(n3, 0) AS n_card, coalesce(n4, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)"""
