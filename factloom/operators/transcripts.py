"""Captions: detection, cues, reflow into paragraphs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Line shapes and limits.
TIMING = re.compile(r"^\s*\d{2}:\d{2}:\d{2}[.,]\d{3}\s*-->\s*\d{2}:\d{2}:\d{2}[.,]\d{3}.*$", re.A)
NUMBER = re.compile(r"^\s*\d+\s*$", re.A)
NOISE = (re.compile(r"<\d{2}:\d{2}:\d{2}[.,]\d{3}>", re.A), re.compile(r"</?[a-zA-Z][^>]*>"))
LABEL = re.compile(r"\[[^\]]*\]")
LOG_LINE = re.compile(r"^\[[a-z][a-z0-9:_-]*\] |(?:/|^)subtitle\.[A-Za-z-]+\.vtt")
DOWNLOADED = re.compile(r"\[download\] 100% of\s+~?[0-9.]+[KMGT]?i?B(?:\s+in\s+[0-9:]+)?(?:\s+at\s+(?:[0-9.]+[KMGT]?i?B/s|Unknown B/s))?(?:\s+ETA\s+[0-9:]+)?(?:\s+\(frag\s+\d+/\d+\))?\s*", re.A)
GAP_SECONDS, CUES = 3.0, 8


def kind_of(text: str) -> str:
    """Vtt, srt, log (two log lines in front) or none."""
    lines = [x.strip() for x in text.split("\n")]
    filled = [x for x in lines if x]
    if filled and filled[0].startswith("WEBVTT"):
        return "vtt"
    if any(NUMBER.match(a) and TIMING.match(b) for a, b in zip(lines, lines[1:])):  # noqa: B905
        return "srt"
    head = next((k for k, x in enumerate(lines) if x), len(lines))
    return "log" if len(lines) > head + 1 and all(LOG_LINE.search(x) for x in lines[head : head + 2]) else "none"


def strip_log(text: str) -> str:
    """Without the leading run of log lines; prose behind a finished download's mark stays."""
    lines, last = text.split("\n"), -1
    for k, line in enumerate(lines):
        if line.strip():
            if not LOG_LINE.search(line.strip()):
                break
            last = k
    if last < 0:
        return text
    marks = list(DOWNLOADED.finditer(lines[last]))
    tail = lines[last][marks[-1].end() :].strip() if marks else ""
    return "\n".join([tail] * bool(tail) + lines[last + 1 :])


def seconds(clock: str) -> float:
    """-1 for what isn't a time."""
    m = re.fullmatch(r"(\d+):(\d+):(\d+(?:[.,]\d+)?)", clock.strip(), re.A)
    return int(m[1]) * 3600.0 + int(m[2]) * 60 + float(m[3].replace(",", ".")) if m else -1.0


def cues_of(text: str) -> list[tuple[str, float]]:
    """(text, start) of every text line; a timing line's start holds until the next."""
    out, start = [], -1.0
    for line in map(str.strip, text.split("\n")):
        if TIMING.match(line):
            start = seconds(line.partition("-->")[0])
        elif line and not line.startswith("WEBVTT") and not NUMBER.match(line):
            for noise in NOISE:
                line = noise.sub("", line)
            if line := " ".join(LABEL.sub(" ", line).split()):
                out.append((line, start))
    return out


def joined(a: str, b: str) -> str | None:
    """One text of two that overlap: one holds the other, or a's last words are b's first, most of them first; in any case."""
    if b in a or a in b:
        return a if b in a else b
    x, y = a.split(), b.split()
    low_x, low_y = [w.casefold() for w in x], [w.casefold() for w in y]
    for n in range(min(len(x), len(y)), 0, -1):
        if low_x[-n:] == low_y[:n]:
            return " ".join(x + y[n:])
    return None


def reflow(cues: list[tuple[str, float]]) -> str:
    """Overlapping cues merge into the one before; a gap over three seconds, or eight untimed cues, end a paragraph."""
    merged: list[tuple[str, float]] = []
    for text, start in cues:
        if merged and (whole := joined(merged[-1][0], text)) is not None:
            merged[-1] = whole, merged[-1][1]
        else:
            merged.append((text, start))
    paragraphs: list[list[str]] = []
    before = -1.0
    for text, start in merged:
        timed = start >= 0 and before >= 0
        if not paragraphs or (start - before > GAP_SECONDS if timed else len(paragraphs[-1]) >= CUES):
            paragraphs.append([])
        paragraphs[-1].append(text)
        before = start
    return "\n\n".join(" ".join(p) for p in paragraphs)


def clean(text: str) -> str:
    """Prose of a transcript; what isn't one, or would be blank, stays as it is."""
    kind = kind_of(text)
    if kind == "log":
        body = strip_log(text)
        return clean(body) if body.strip() and body != text else text
    if kind == "none":
        return text
    flowed = reflow(cues_of(text))
    return flowed if flowed.strip() else text


@F.pandas_udf(T.StringType())
def clean_udf(text: pd.Series) -> pd.Series:
    return text.fillna("").map(clean)


@F.pandas_udf(T.StringType())
def kind_udf(text: pd.Series) -> pd.Series:
    return text.fillna("").map(kind_of)
