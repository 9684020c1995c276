"""Sentence splitting: state machines over characters, which expressions can't follow; they run in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import freed, slices

# Abbreviations that end no sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr prof sr jr st vs etc e.g i.e u.s u.k".split())
_BULLET = re.compile(r"[-*+] |[0-9]+\. .")
_SIMPLE = re.compile(r"[.?!]+[\"'”’)\]]*(?=\s|$)")


def is_bullet(line: str) -> bool:
    return bool(_BULLET.match(line)) and (line[0] in "-*+" or len(line) >= 4)


_BLANKS = re.compile(r"[ \t\n\r]*")


class _Word:
    """The word in front of a mark, without quotes and brackets at its ends; marks come in order, and each character is looked at a few times in all."""

    QUOTES = "\"'([{"

    def __init__(self, s: str):
        self.s, self.spaces = s, re.finditer(r"\s+", s)
        self.begin = self.scanned = self.plain = 0
        self.next = next(self.spaces, None)

    def before(self, i: int) -> tuple[str, str]:
        """(the word in lower case without dots at its ends, if it is short, the word if it is one character); else ""."""
        s = self.s
        while self.next and self.next.end() <= i:
            self.begin = self.scanned = self.plain = self.next.end()
            self.next = next(self.spaces, None)
        while self.begin < i and s[self.begin] in self.QUOTES:
            self.begin += 1
        while self.scanned < i:  # plain: behind the last character that is no dot
            self.scanned += 1
            if s[self.scanned - 1] != ".":
                self.plain = self.scanned
        end = i
        while end > self.begin and s[end - 1] in self.QUOTES:
            end -= 1
        stop = self.plain if end == i else end
        while stop > self.begin and s[stop - 1] == ".":
            stop -= 1
        start = self.begin
        while start < stop and s[start] == ".":
            start += 1
        short = s[start:stop].lower() if 0 < stop - start <= 8 else ""
        return short, s[self.begin : end] if end - self.begin == 1 else ""


def _ends_sentence(s: str, i: int, word: _Word) -> bool:
    if 0 < i < len(s) - 1 and s[i - 1].isascii() and s[i - 1].isdigit() and s[i + 1].isascii() and s[i + 1].isdigit():
        return False
    following = _BLANKS.match(s, i + 1).end()
    if following == len(s):
        return True
    if not s[following].isupper():
        return False
    short, single = word.before(i)
    return short not in ABBREVIATIONS and not (single.isascii() and single not in ("", "I"))


def _paragraph(s: str) -> list[str]:
    out, start, s = [], 0, s.strip()
    word = _Word(s)
    for m in re.finditer(r"[.!?]", s):
        if m.start() >= start and _ends_sentence(s, m.start(), word):
            out.append(s[start : m.end()].strip())
            start = _BLANKS.match(s, m.end()).end()
    return [x for x in [*out, s[start:].strip()] if x]


def split_sentences(text: str) -> list[str]:
    """C11: headings and fenced code are left out, a bullet is one unit, paragraphs end at blank lines.

    A sentence ends at . ! ? before a capital or the end, not inside a number and
    not behind an abbreviation or initial.
    """
    out: list[str] = []
    held: list[str] = []
    fenced = False
    for line in [*(text or "").split("\n"), ""]:
        line = line.strip()
        fence = line.startswith(("```", "~~~"))
        if fenced and not fence:
            continue
        plain = line and not fence and not line.startswith("#") and not is_bullet(line)
        if plain:
            held.append(line)
            continue
        out += _paragraph(" ".join(held))
        held = []
        if fence:
            fenced = not fenced
        elif line and is_bullet(line):
            out.append(line)
    return out + _paragraph(" ".join(held))


def simple_sentences(text: str) -> list[str]:
    """Sentences end at . ? ! with the closing quotes and brackets behind, before white space or the end."""
    out, start = [], 0
    for m in _SIMPLE.finditer(text or ""):
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, (text or "")[start:].strip()] if s]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        for part in slices(text, text.str.len()):
            yield part.map(split_sentences)
    freed()


@F.pandas_udf(T.ArrayType(T.StringType()))
def simple_sentences_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        for part in slices(text, text.str.len()):
            yield part.map(simple_sentences)
    freed()


@F.pandas_udf(T.StructType([T.StructField("careful", T.IntegerType()), T.StructField("simple", T.IntegerType())]))
def sentence_counts_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """How many sentences either splitter finds: the sentences stay where they are made, one text's at a time."""
    for text in batches:
        counts = [(len(split_sentences(t)), len(simple_sentences(t))) for t in text]
        yield pd.DataFrame(counts, columns=["careful", "simple"], dtype="int32")
    freed()
