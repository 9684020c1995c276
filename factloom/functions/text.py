"""Text functions. All are built-in expressions, so they stay in generated code and never start Python.

White space is ASCII unless said otherwise: the class below, spelled out because
regex engines differ in what ``\\s`` holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t\n\f\r ]"

# Patterns, thresholds and word lists that results depend on.
DATA_IMAGE = r"!\[[^\]]*\]\(\s*data:[^)]*\)"
HTML_DATA_IMAGE = r"(?i)<img[^>]*\bsrc\s*=\s*[\"']data:[^\"']*[\"'][^>]*>"
BASE64_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{1024,}={0,2}"  # tried where a run begins only, so that a run is read once
NUMBER = r"[$€£]?\d[\d,]*(?:\.\d+)?(?:%|[KMB])?"
ACRONYM = r"(?<![A-Za-z0-9_])[A-Z]{2,}(?![A-Za-z0-9_])"
PROPER = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:[\t\n\f\r ]+[A-Z][a-z]+)+(?![A-Za-z0-9_])"
ID_CODE = r"(?<![A-Za-z0-9_])(?=[0-9-]*[A-Z])[A-Z0-9]{4}-[A-Z0-9]{3}(?![A-Za-z0-9_])"
LEAD_WORDS = "the a an this that these those it in on at as of and but or for to from with by we they he she his her its their".split()
DENSE_BYTES_PER_WORD = 40
SHINGLE = 8
INLINE_TIME = r"<\d{2}:\d{2}:\d{2}[.,]\d{3}>"
STYLE_TAG = r"</?[a-zA-Z][^>]*>"
BRACKET_LABEL = r"\[[^\]]*\]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used: a lambda's argument isn't inlined."""
    return F.transform(F.array(value), body)[0]


def squeeze(x: Column) -> Column:
    """Runs of white space are one space; none at the ends."""
    return F.trim(F.regexp_replace(x, WS + "+", " "))


def normalize(x: Column) -> Column:
    """Lower case, no comma between digits, single spaces."""
    return squeeze(F.regexp_replace(F.lower(x), r"([0-9]),([0-9])", "$1$2"))


def word_count(x: Column) -> Column:
    return let(squeeze(x), lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, " "))))


def fact_key(x: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends."""
    return F.regexp_replace(squeeze(F.lower(x)), r"^\p{P}+|\p{P}+$", "")


def token_pattern(anchor: str) -> str | None:
    """The regular expression that finds a normalized anchor at token boundaries; None for the empty anchor.

    A digit at its edge isn't flanked by a digit or by a decimal point with a
    digit beyond; a letter a-z at its edge isn't flanked by a letter a-z.
    """
    if not anchor:
        return None
    left = r"(?<![0-9])(?<![0-9]\.)" if anchor[0] in "0123456789" else "(?<![a-z])" if "a" <= anchor[0] <= "z" else ""
    right = r"(?![0-9])(?!\.[0-9])" if anchor[-1] in "0123456789" else "(?![a-z])" if "a" <= anchor[-1] <= "z" else ""
    return left + re.sub(r"([^A-Za-z0-9 ])", r"\\\1", anchor) + right


def contains_token(norm: Column, anchor: str) -> Column:
    pattern = token_pattern(anchor)
    return F.lit(False) if pattern is None else norm.rlike(pattern)


def token_pattern_of(anchor: Column) -> Column:
    """``token_pattern`` of a column of normalized anchors; for the empty anchor a pattern that nothing has."""
    quoted = F.regexp_replace(anchor, r"([^A-Za-z0-9 ])", r"\\$1")
    left = F.when(anchor.rlike("^[0-9]"), r"(?<![0-9])(?<![0-9]\.)").when(anchor.rlike("^[a-z]"), "(?<![a-z])").otherwise("")
    right = F.when(anchor.rlike("[0-9]$"), r"(?![0-9])(?!\.[0-9])").when(anchor.rlike("[a-z]$"), "(?![a-z])").otherwise("")
    return F.when(anchor == "", "(?!)").otherwise(F.concat(left, quoted, right))


def meaningful_number(x: Column) -> Column:
    """Two characters at least behind the currency sign, or a currency or percent sign."""
    return (F.length(F.regexp_replace(x, "^[$€£]+", "")) >= 2) | x.rlike("[$€£%]")


def trim_proper_lead(x: Column) -> Column:
    """A proper noun without a stop word in front; null with fewer than two words left."""
    return let(F.split(squeeze(x), " "), _without_lead)


def _without_lead(words: Column) -> Column:
    words = F.when(F.lower(words[0]).isin(LEAD_WORDS), F.slice(words, 2, F.size(words))).otherwise(words)
    return F.when(F.size(words) >= 2, F.array_join(words, " "))


def specifics(x: Column) -> Column:
    """Numbers, acronyms and proper nouns of a text, each in its own form, in that order."""
    numbers = F.filter(F.regexp_extract_all(x, F.lit(NUMBER), 0), meaningful_number)
    acronyms = F.regexp_extract_all(x, F.lit(ACRONYM), 0)
    nouns = F.filter(F.transform(F.regexp_extract_all(x, F.lit(PROPER), 0), trim_proper_lead), lambda s: s.isNotNull())
    return F.concat(numbers, acronyms, nouns)


def shingles(x: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` words [a-z0-9]+ of the lower-cased text."""
    def runs(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), 0), runs)


def strip_blobs(x: Column) -> Column:
    """Data-URI images and long base64 runs go."""
    x = F.regexp_replace(x, DATA_IMAGE, "")
    x = F.regexp_replace(x, HTML_DATA_IMAGE, "")
    return F.regexp_replace(x, BASE64_RUN, "")


def normalize_input(x: Column) -> Column:
    """No byte-order mark, line feeds only."""
    return F.regexp_replace(F.regexp_replace(x, "^﻿", ""), "\r\n?", "\n")


def dense(x: Column) -> Column:
    """Over 40 bytes a word."""
    words = word_count(x)
    return F.when(words > 0, F.floor(F.octet_length(x) / F.greatest(words, F.lit(1))) > DENSE_BYTES_PER_WORD).otherwise(False)


def strip_cue_noise(x: Column) -> Column:
    """P06"""
    x = F.regexp_replace(F.regexp_replace(x, INLINE_TIME, ""), STYLE_TAG, "")
    return squeeze(F.regexp_replace(x, BRACKET_LABEL, " "))


def clock_seconds(x: Column) -> Column:
    """HH:MM:SS.mmm as seconds, -1 where it isn't one."""
    part = lambda k: F.regexp_extract(x, r"^([0-9]+):([0-9]+):([0-9]+(?:[.,][0-9]+)?)$", k)
    value = part(1).try_cast("double") * 3600 + part(2).try_cast("double") * 60 + F.regexp_replace(part(3), ",", ".").try_cast("double")
    return F.coalesce(value, F.lit(-1.0))


def canonicalize(x: Column) -> Column:
    """No heading, bullet or emphasis marks, no first non-blank line, single spaces."""
    x = F.regexp_replace(x, "\r\n?", "\n")
    x = F.regexp_replace(x, r"(?m)^#+[\t\n\f\r ]+", "")
    x = F.regexp_replace(x, r"(?m)^[-*][\t\n\f\r ]+", "")
    x = F.regexp_replace(x, "[*_]", "")
    x = F.regexp_replace(x, r"^(?:[\t\f\r ]*\n)*[^\n]*[^\t\n\f\r ][^\n]*(?:\n|$)", "")
    return squeeze(x)


def drop_heading_lines(x: Column) -> Column:
    """P10"""
    return F.array_join(F.filter(F.split(x, "\n"), lambda s: ~s.rlike(r"^[\t\f\r ]*#")), "\n")


def strip_id_codes(x: Column) -> Column:
    """XXXX-XXX codes with a letter are blanked."""
    return F.regexp_replace(x, ID_CODE, " ")


CITATION = r"\[[Ff][0-9]+(?:[\t\n\f\r ]*,[\t\n\f\r ]*[Ff]?[0-9]+)*\]"


def citation_ids(x: Column) -> Column:
    """Distinct fact ids in [F1, f2, 3] marks, ascending."""
    marks = F.array_join(F.regexp_extract_all(x, F.lit(CITATION), 0), " ")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(marks, F.lit("[0-9]+"), 0), lambda s: s.cast("int"))))


def strip_citations(x: Column) -> Column:
    """Marks go with the space that they leave before punctuation, after a bracket, or twice."""
    x = F.regexp_replace(x, CITATION, "")
    x = F.regexp_replace(x, " +(?=[.,;:!?)])", "")
    x = F.regexp_replace(x, r"(?<=\() +", "")
    x = F.regexp_replace(x, " {2,}", " ")
    return F.regexp_replace(x, r"(?m)[\t ]+$", "")


def reusable(x: Column) -> Column:
    """Neither blank nor a placeholder for a failed call."""
    low = F.lower(x)
    return (F.trim(x) != "") & ~low.contains("could not be generated") & ~low.contains("empty response")


def label_normalize(x: Column) -> Column:
    """Lower case, all but letters, digits and spaces is a space."""
    return squeeze(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\t\n\f\r ]+", " "))


def parse_label(x: Column, allowed: list[str]) -> Column:
    """The label that the text is, or the one allowed label that it has as a phrase; else null."""
    norm = label_normalize(x)
    names = F.array(*[F.struct(F.lit(a).alias("label"), label_normalize(F.lit(a)).alias("norm")) for a in allowed])
    same = F.filter(names, lambda a: a["norm"] == norm)
    within = F.filter(names, lambda a: F.concat(F.lit(" "), norm, F.lit(" ")).contains(F.concat(F.lit(" "), a["norm"], F.lit(" "))))
    return F.when(F.size(same) > 0, same[0]["label"]).when(F.size(within) == 1, F.get(within, F.lit(0))["label"])


def title_normalize(x: Column) -> Column:
    """Letters and digits in lower case, one space for a run of white space, punctuation deleted."""
    return squeeze(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}\t\n\f\r ]", ""))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length over lower-cased characters; 1 if both are empty."""
    a, b = F.lower(a), F.lower(b)  # names are short: no need to bind them
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def url_normalize(x: Column) -> Column:
    """X11: lower case without scheme, www., query, fragment and trailing slash."""
    x = F.regexp_replace(F.lower(F.trim(x)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "^www[.]", ""), "[?#].*$", ""), "/+$", "")


def first_number(x: Column) -> Column:
    """The first number of a cell, commas dropped."""
    return F.regexp_replace(F.regexp_extract(x, r"-?[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")


def pipe_cells(line: Column) -> Column:
    """Cells of a pipe-table row without empty ones at its edges; null for empty and separator rows."""
    return let(F.transform(F.split(F.trim(line), r"\|"), lambda c: F.trim(c)), _inner_cells)


def _inner_cells(cells: Column) -> Column:
    cells = F.when(cells[0] == "", F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)
    cells = F.when((F.size(cells) > 0) & (F.get(cells, F.size(cells) - 1) == ""), F.slice(cells, 1, F.greatest(F.size(cells) - 1, F.lit(0)))).otherwise(cells)
    return F.when(F.exists(cells, lambda c: ~c.rlike("^:?-*:?$")), cells)


def family(slug: Column) -> Column:
    """X22"""
    return F.split_part(slug, F.lit("/"), F.lit(1))


def cosine(a: Column, b: Column) -> Column:
    """In double, 0 for empty, unequal lengths and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def last_line(x: Column) -> Column:
    """The last line that isn't blank, without white space behind; empty if there is none."""
    kept = F.filter(F.transform(F.split(x, "\n"), lambda s: F.regexp_replace(s, r"[\t\f\r ]+$", "")), lambda s: s != "")
    return F.when(F.size(kept) > 0, F.element_at(kept, -1)).otherwise("")


def fenced_code(x: Column) -> Column:
    """The inside of the first code fence, or the whole text."""
    inside = F.regexp_extract(x, r"(?s)```[A-Za-z]*\n(.*?)```", 1)
    return F.when(inside != "", inside).otherwise(x)


def hash_key(*parts: Column, separator: str = "\x00") -> Column:
    """SHA-256 of parts joined by a separator that they don't hold."""
    return F.sha2(F.concat_ws(separator, *parts), 256)


def token_estimate(x: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(x) / 4).cast("long")


def grounded(reason: Column, winner: Column, least: int = 8) -> Column:
    """A quoted span of ``least`` characters or more of the reason is in the winner."""
    said = F.transform(F.regexp_extract_all(reason, F.lit('"([^"]{%d,})"' % least), 1), lambda q: squeeze(F.lower(q)))
    return let(squeeze(F.lower(winner)), lambda w: F.exists(said, lambda q: F.contains(w, q)))


def first_integer(x: Column, size: Column) -> Column:
    """The first integer of a reply if it is in 0 .. size-1."""
    i = F.regexp_extract(x, "[0-9]+", 0).try_cast("int")
    return F.when((i >= 0) & (i < size), i)


def retry_delay_ms(attempt: Column, base_ms: int = 500, most_ms: int = 8000) -> Column:
    """Base, doubled by each attempt, capped."""
    return F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.least(attempt, F.lit(40)) - 1), F.lit(float(most_ms))).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / b)


def harmonic(p: Column, r: Column) -> Column:
    """F1, 0 where both are 0."""
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def confidence(x: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(x * 100 + 0.5) / 100


def comparison_bound(n: Column) -> Column:
    """N * ceil(log2 n) comparisons of a merge sort."""
    return F.when(n < 2, F.lit(0)).otherwise(n * F.ceil(F.log2(n))).cast("long")


def fact_tokens(x: Column) -> Column:
    """Words without punctuation at their ends, blanks dropped."""
    words = F.transform(F.split(squeeze(F.lower(x)), " "), lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", ""))
    return F.filter(words, lambda w: w != "")
