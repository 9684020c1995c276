"""Quality rules: rules vote or abstain, EM estimates how accurate each is, a posterior decides; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, settled

SPACES, SPACE, SYMBOLS = " \t\n\v\f\r", r"\x20\x09-\x0D", r"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Frequent words of some languages, by which prose is told from lists and noise.
COMMON = "the and of to in is that for was on der die und den das von ist nicht le la les de et des un une el los que y en".split()


class Rule(NamedTuple):
    """A vote on one measure: good up to ``good``, bad from ``bad`` on, none between them; with ``good`` over ``bad``, the other way round."""

    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        """1, -1, or 0 where the rule abstains: between its limits, or without a measure."""
        m, up = F.col(self.measure), self.good > self.bad
        return F.when(m >= self.good if up else m <= self.good, 1).when(m <= self.bad if up else m >= self.bad, -1).otherwise(0)


#: Shares of a text's words or lines; the limits are wide apart, so that doubtful texts get few votes.
RULES: tuple[Rule, ...] = (
    Rule("symbols", 0.02, 0.25),  # per word
    Rule("repeated_words", 0.1, 0.3),
    Rule("repeated_lines", 0.05, 0.4),
    Rule("capitals", 0.1, 0.4),  # of the characters of words
    Rule("common_words", 0.04, 0.005),
    Rule("odd_length", 2.5, 4.0),  # how far the mean length of a word is from 5.5
)


#: Bits of a number that hold a window's place in its text; the others hold its hash.
PLACE_BITS = 24


def _twins(places: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Those of the sorted ``places`` that are the same as a neighbour; ``places`` is a column, as it is read per place."""
    return F.filter(places, lambda x, k: F.coalesce(same(x, F.get(places, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(places, k + 1)), F.lit(False)))


def _n_repeat_words(rows: DataFrame) -> DataFrame:
    """``rows`` with n_repeat_words: how many of the column ``words`` stand in a window of three that their text holds more than once.

    Windows are hashed; a text whose hashes are distinct repeats none. In the others
    a window becomes one number, its hash in front of its place, so that equal
    windows are neighbours once these are sorted. Neighbours of one hash are
    compared by their words; a text in which different windows share a hash, or
    with more words than a place has room for, has its windows sorted as they are.
    The places found, in order, tell how many words their windows cover.
    """
    words, hashes, packed, exact = F.col("words"), F.col("_hashes"), F.col("_packed"), F.col("_exact")
    n, tail = F.size(words) - 2, F.lit((1 << PLACE_BITS) - 1).cast("long")
    window = lambda at: F.slice(words, at + 1, F.lit(3))
    each = F.transform(words, lambda w, at: F.xxhash64(w, F.get(words, at + 1), F.get(words, at + 2)))
    rows = rows.withColumn("_hashes", F.when(n > 1, F.slice(each, F.lit(1), n)))
    rows = rows.withColumn("_hashes", F.when(F.size(F.array_distinct(hashes)) < n, hashes))
    close = lambda x, y: F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS)
    place = lambda x: x.bitwiseAND(tail).cast("int")
    numbered = F.transform(hashes, lambda h, at: h.bitwiseAND(F.bitwise_not(tail)).bitwiseOR(at.cast("long")))
    rows = rows.withColumn("_packed", F.when(n < 1 << PLACE_BITS, F.sort_array(numbered))).withColumn("_packed", _twins(packed, close))
    clash = F.exists(F.zip_with(packed, F.slice(packed, 2, F.size(packed)), lambda x, y: close(x, y) & (window(place(x)) != window(place(y)))), lambda c: c)
    spelled = F.transform(hashes, lambda _, at: F.struct(window(at).alias("window"), at.alias("at")))
    rows = rows.withColumn("_clash", F.coalesce(clash, n >= 1 << PLACE_BITS)).withColumn("_exact", F.when(F.col("_clash"), F.sort_array(spelled)))
    slow = F.transform(_twins(exact, lambda x, y: x["window"] == y["window"]), lambda x: x["at"])
    rows = rows.withColumn("_places", F.sort_array(F.when(F.col("_clash"), slow).otherwise(F.transform(packed, place))))
    places = F.col("_places")
    covered = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda x, y: x + y), F.lit(0))).drop("_hashes", "_packed", "_clash", "_exact", "_places")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the measures of RULES, of every row's whole text."""
    body, words = F.col("body"), F.col("words")
    trimmed = F.trim(body, F.lit(SPACES))
    filled = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(rf"[^{SPACE}]")))
    split = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    split = split.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))).withColumn("lines", filled)
    counted = split.select(
        "doc_id", "words", F.size(words).alias("n_words"), F.length(F.array_join(words, "")).alias("word_chars"),
        F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).alias("n_symbols"), F.length(F.regexp_replace(body, r"\P{Lu}+", "")).alias("n_capitals"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("lines").alias("n_lines"),
        F.size(F.filter(words, lambda w: w.isin(*COMMON))).alias("n_common"),
    )
    part = lambda c, whole: F.when(F.col(whole) > 0, F.col(c) / F.col(whole))
    return _n_repeat_words(counted).select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in COUNTS),
        part("n_symbols", "n_words").alias("symbols"), part("n_repeat_words", "n_words").alias("repeated_words"), part("n_dup_lines", "n_lines").alias("repeated_lines"),
        part("n_capitals", "word_chars").alias("capitals"), part("n_common", "n_words").alias("common_words"), F.abs(part("word_chars", "n_words") - 5.5).alias("odd_length"),
    )


class Model(NamedTuple):
    """What EM has found: the share of good texts, and how often each rule, when it votes, is right on good and on bad ones."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def probability(self, votes: Sequence[int]) -> float:
        """That a text with these votes is good; rules are taken as independent, an abstention as no evidence."""
        good, bad = self.share, 1 - self.share
        for v, a, b in zip(votes, self.on_good, self.on_bad, strict=True):
            if v:
                good *= a if v > 0 else 1 - a
                bad *= 1 - b if v > 0 else b
        return good / (good + bad)


#: Where EM begins, and what it is drawn to, as if by the votes of a hundredth of all texts: nearly all votes on good texts
#: are right, as a rule looks for one fault; a bad text has some of the faults.
START, PULL = Model(0.8, (0.95,), (0.4,)), 0.01


def estimated(patterns: Sequence[tuple[tuple[int, ...], int]], rules: int, rounds: int = 30) -> Model:
    """Accuracies of the rules by expectation-maximisation over (votes, number of rows with them).

    There are at most three to the power of the rules of such patterns, whatever
    the number of rows. Accuracies are drawn to START by PULL, so that a rule that
    never votes bad, or a corpus without a bad text, leaves a sane model. Without
    rows it is START.
    """
    model = start = Model(START.share, START.on_good * rules, START.on_bad * rules)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        sums = [[PULL * total * x for x in (g, 1, b, 1)] for g, b in zip(start.on_good, start.on_bad, strict=True)]
        good = PULL * total * start.share
        for votes, n in patterns:
            p = model.probability(votes)
            good += n * p
            for s, v in zip(sums, votes, strict=True):
                if v:
                    s[0] += n * p * (v > 0)
                    s[1] += n * p
                    s[2] += n * (1 - p) * (v < 0)
                    s[3] += n * (1 - p)
        model = Model(good / (total + PULL * total), tuple(s[0] / s[1] for s in sums), tuple(s[2] / s[3] for s in sums))
    return model


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, rounds: int = 30, least: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with its measures, and the probability that its text is good, by rules that vote or abstain.

    In place of a filter that every rule must pass: each rule votes good, bad or
    not at all; EM over the votes of all rows estimates the share of good texts
    and each rule's accuracies; a row's posterior follows from its votes. Texts are
    read once, into a table of measures; the driver gets how many rows have the
    same votes (3 ** rules patterns at most), and the posteriors of the patterns
    are broadcast back.

    base_failed: under 50 words, or over half of them in repeated windows of three.
    kept: not base_failed, and a posterior of ``least`` or more.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, posterior. Null text: as empty, no words, base_failed. A rule
    without a measure (a text without words, lines or letters) abstains. Null
    and repeated ids: each row is judged by its own text. Empty table: no rows.
    Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    voted = tables.write(measured(docs, id_col, text_col).select("doc_id", *COUNTS, F.array(*(r.vote().cast("int") for r in rules)).alias("votes")))
    patterns = sorted((tuple(r.votes), r.rows) for r in voted.groupBy("votes").agg(F.count("*").alias("rows")).collect())
    model = estimated(patterns, len(rules), rounds)
    known = docs.sparkSession.createDataFrame([(list(v), model.probability(v)) for v, _ in patterns], "votes array<int>, posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.join(F.broadcast(known), "votes").withColumn("base_failed", failed)
    return settled(judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"), "posterior"))
