"""Personal data in disguise: offset-preserving deobfuscation before detection.

Base patterns run on the text as it is.  Then transducers rewrite the text while they keep, for every
character they emit, the source characters it came from: look-alike letters, wide and other Unicode
digits become ASCII; invisible characters go; spelled digits ("five five") become digits; "(at)", "[dot]"
and, between words, " at " with " dot " become "@" and ".".  The same patterns run on the result, and
their spans are mapped back to the source.  A span that meets a base span of its kind isn't added.

Defined cases: null and empty texts have no spans; rows are treated one by one, whatever repeats; an
empty table gives an empty result; other columns are not read.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import table

KINDS = ("email", "ip", "card", "phone")
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs are taken whole: a start inside a run of digits can match only if the run's start does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LUHN = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    return sum(_LUHN[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ can belong to one match only: the run of local characters before it, and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def small(part: str) -> bool:
    return len(q := part.lstrip("0")) <= 3 and int(q or 0) <= 255


def detect(text: str) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end), sorted."""
    found = [(0, *x) for x in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(small, m[0].split("."))):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ո": "n",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K", "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    "ı": "i", "ɡ": "g", "ɑ": "a", "‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "﹒": ".", "﹫": "@",
    " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[%s%s！-～\U0001d400-\U0001d7ff٠-٩۰-۹०-९²³¹⁰-⁹₀-₉①-⑨]" % (re.escape(INVISIBLE), "".join(HOMOGLYPHS)))
_DIGIT_WORD = re.compile(r"(?i)(?<![A-Za-z])(plus|%s)(?![A-Za-z])" % "|".join(DIGITS))
_DIGIT_LINK = re.compile(r"(?i)[ ,-]{0,2}|( +(?:dot|point) +)")
_BRACKETED = re.compile(r"(?i)\s{0,3}[\[({<_]\s{0,3}(at|dot|@|\.)\s{0,3}[\])}>_]\s{0,3}")
_SAID = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)(?:( +at +)|( ?@ ?))(?!(?:the|an?|this|that|my|your|our|its) )([A-Za-z0-9-]++)((?: +dot +[A-Za-z0-9-]++)+)(?![A-Za-z0-9-])")
_SAID_DOT = re.compile(r"(?i) +dot +")
_DIGIT_DOT = re.compile(r"(?i)(?<=[0-9]) +(?:dot|point) +(?=[0-9])")
_WORTH = re.compile(r"(?i)(?<![A-Za-z])(?:dot|point|%s)(?![A-Za-z])|[\[({<_]\s{0,3}(?:at|@|\.)" % "|".join(DIGITS))


class Mapped:
    """A text and, for each of its characters, the source characters it stands for (none: the text is the source)."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """edits: (start, end, new text), in order and apart; what is new stands for all that it replaces."""
        if not edits:
            return self
        old_starts = self.starts or list(range(len(self.text)))
        old_ends = self.ends or list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for s, e, new in edits:
            text += (self.text[at:s], new)
            starts += old_starts[at:s] + [old_starts[s]] * len(new)
            ends += old_ends[at:s] + [old_ends[e - 1]] * len(new)
            at = e
        return Mapped("".join([*text, self.text[at:]]), starts + old_starts[at:], ends + old_ends[at:])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return (self.starts[start], self.ends[end - 1]) if self.starts else (start, end)


def plain_letters(m: Mapped) -> Mapped:
    edits = []
    for x in _ODD.finditer(m.text):
        c = x[0]
        new = "" if c in INVISIBLE else HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
        if not new.isascii() and (d := unicodedata.digit(c, None)) is not None:
            new = str(d)
        if new.isascii():
            edits.append((*x.span(), new))
    return m.rewrite(edits)


def said_signs(m: Mapped) -> Mapped:
    m = m.rewrite([(*x.span(), {"at": "@", "dot": "."}.get(x[1].lower(), x[1])) for x in _BRACKETED.finditer(m.text) if x.start() and x.end() < len(m.text)])
    edits = []
    for x in _SAID.finditer(m.text):
        g = 2 if x[2] else 3
        edits.append((x.start(g), x.end(g), "@"))
        edits += [(d.start(), d.end(), ".") for d in _SAID_DOT.finditer(m.text, x.start(5), x.end(5))]
    return m.rewrite(edits)


def spelled_digits(m: Mapped) -> Mapped:
    """Runs of two or more spelled digits become digits; the blanks between two of them go, a spelled dot stays as one."""
    edits: list[tuple[int, int, str]] = []
    run: list[re.Match] = []

    def close() -> None:
        if sum(x[1].lower() != "plus" for x in run) >= 2:
            for x, y in zip(run, [*run[1:], None], strict=True):
                new = "+" if x[1].lower() == "plus" else DIGITS[x[1].lower()]
                new += "." if y and _DIGIT_LINK.fullmatch(m.text, x.end(), y.start())[1] else ""
                edits.append((x.start(), y.start() if y else x.end(), new))

    for x in _DIGIT_WORD.finditer(m.text):
        if run and (x[1].lower() == "plus" or not _DIGIT_LINK.fullmatch(m.text, run[-1].end(), x.start())):
            close()
            run = []
        run.append(x)
    close()
    return m.rewrite(edits)


def deobfuscated(text: str) -> Mapped:
    m = said_signs(spelled_digits(plain_letters(Mapped(text))))
    return m.rewrite([(*x.span(), ".") for x in _DIGIT_DOT.finditer(m.text)])


def added(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that show only after deobfuscation."""
    if (text.isascii() or not _ODD.search(text)) and not _WORTH.search(text):
        return []
    m = deobfuscated(text)
    if m.text == text:
        return []
    starts, ends = ([[b[i] for b in base if b[0] == kind] for kind in range(len(KINDS))] for i in (1, 2))
    out = []
    for kind, s, e in detect(m.text):
        s, e = m.source(s, e)
        before = bisect.bisect_left(starts[kind], e) - 1  # base spans are sorted and apart: the last that starts before e reaches furthest
        if before < 0 or ends[kind][before] <= s:
            out.append((kind, s, e))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, all spans, and the number of spans that deobfuscation added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in b.column("text").to_pylist():
                base = detect(text or "")
                more = added(text or "", base)
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(base + more))
                out[6].append(len(more))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.string() if i in (4, 5) else pa.int64()) for i, x in enumerate(out))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def op8_personal_data(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), n_added."""
    return find(table(spark, sf_dir, "documents"))
