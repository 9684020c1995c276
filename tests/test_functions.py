import time
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.functions.sentences import simple_sentences, split_sentences


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())).select(expr.alias("v")).first().v


def boundary(norm, anchor):
    """The rule of token matches, position by position."""
    for p in (m.start() for m in re.finditer(f"(?={re.escape(anchor)})", norm) if anchor):
        q = p + len(anchor)
        left, right = norm[:p], norm[q:]
        if anchor[0].isdigit():
            ok = not re.search(r"[0-9]$|[0-9]\.$", left)
        else:
            ok = not ("a" <= anchor[0] <= "z" and re.search("[a-z]$", left))
        if anchor[-1].isdigit():
            ok &= not re.match(r"[0-9]|\.[0-9]", right)
        elif "a" <= anchor[-1] <= "z":
            ok &= not re.match("[a-z]", right)
        if ok:
            return True
    return False


def test_token_boundaries_match_the_rule(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("a1.2 b-$", k=rng.randrange(1, 12))), "".join(rng.choices("a1.b$", k=rng.randrange(0, 4)))) for _ in range(1500)]
    rows += [("in 2025 it", "25"), ("25.5 km", "25"), ("ends in 25.", "25"), ("1200 usd", "1200"), ("cat", "at"), ("v. 2", "v.")]
    df = spark.createDataFrame(rows, "norm string, anchor string").withColumn("hit", F.regexp_like("norm", X.token_pattern_of(F.col("anchor"))))
    for r in df.collect():
        assert r.hit == boundary(r.norm, r.anchor), r
    for norm, anchor in rows[-6:]:
        assert one(spark, X.contains_token(F.col("n"), anchor), n=norm) == boundary(norm, anchor)


@pytest.mark.parametrize(("text", "want"), [("  A\tB\n1,234,5 ", "a b 12345"), ("", ""), ("1,2", "12")])
def test_normalize(spark, text, want):
    assert one(spark, X.normalize(F.col("t")), t=text) == want


def test_fact_key_and_titles(spark):
    assert one(spark, X.fact_key(F.col("t")), t="**Hello,  World!** ") == "hello, world"
    assert one(spark, X.title_normalize(F.col("t")), t=" The  Cost: (2) ") == "the cost 2"


def test_specifics(spark):
    text = "The Voyager Probe cost $1,200 and 3.5% in 1977; NASA and In Paris, New York City saw 7 of 8."
    assert one(spark, X.specifics(F.col("t")), t=text) == ["$1,200", "3.5%", "1977", "NASA", "Voyager Probe", "New York City"]


def test_blobs(spark):
    text = "a ![x](data:image/png;base64,AAA) b <IMG alt='q' src = \"data:y\"> c " + "A" * 1023 + " " + "B" * 1024 + "=="
    assert one(spark, X.strip_blobs(F.col("t")), t=text) == "a  b  c " + "A" * 1023 + " "


@pytest.mark.parametrize(("text", "want"), [("01:02:03.500", 3723.5), ("00:00:01,250", 1.25), ("1:2", -1.0), ("x", -1.0), ("", -1.0)])
def test_clock(spark, text, want):
    assert one(spark, X.clock_seconds(F.col("t")), t=text) == want


def test_canonicalize(spark):
    assert one(spark, X.canonicalize(F.col("t")), t="\n# Title\r\n## Part *one*\n- a_b\n* c") == "Part one ab c"
    assert one(spark, X.canonicalize(F.col("t")), t="only") == ""


def test_citations(spark):
    text = "It is so [F1, f3]. And ( [F2] ) more [F10,2] , yes [x]."
    assert one(spark, X.citation_ids(F.col("t")), t=text) == [1, 2, 3, 10]
    assert one(spark, X.strip_citations(F.col("t")), t=text) == "It is so. And () more, yes [x]."


@pytest.mark.parametrize(("said", "want"), [("Bug.", "bug"), ("it is a BUG!", "bug"), ("debug", None), ("bug or question", None), ("feature request", "feature request"), ("", None)])
def test_labels(spark, said, want):
    assert one(spark, X.parse_label(F.col("t"), ["bug", "question", "feature request"]), t=said) == want


def test_urls_numbers_cells(spark):
    assert one(spark, X.url_normalize(F.col("t")), t="HTTPS://www.A.org/p/?q=1#x") == "a.org/p"
    assert one(spark, X.first_number(F.col("t")), t="about 1,234.5 pts") == 1234.5
    assert one(spark, X.first_number(F.col("t")), t="none") is None
    assert one(spark, X.pipe_cells(F.col("t")), t="| a | b |") == ["a", "b"]
    assert one(spark, X.pipe_cells(F.col("t")), t="|---|:-:|") is None


def test_last_line_code_and_keys(spark):
    assert one(spark, X.last_line(F.col("t")), t="a\n b \n\n") == " b"
    assert one(spark, X.last_line(F.col("t")), t="\n") == ""
    assert one(spark, X.fenced_code(F.col("t")), t="x\n```python\ny = 1\n```\nz") == "y = 1\n"
    assert one(spark, X.levenshtein_similarity(F.col("a"), F.col("b")), a="héé", b="HEE") == pytest.approx(1 / 3)


def test_shingles_of_short_and_repeated_texts(spark):
    assert one(spark, X.shingles(F.col("t")), t="a b c d e f g") == []
    assert one(spark, X.shingles(F.col("t")), t="A " * 9) == ["a a a a a a a a"]


def test_retry_and_bounds(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 5, 9)], "n int")
    assert [r.v for r in df.select(X.retry_delay_ms(F.col("n")).alias("v")).collect()] == [500, 1000, 8000, 8000]
    assert [r.v for r in df.select(X.comparison_bound(F.col("n")).alias("v")).collect()] == [0, 2, 15, 36]


def test_careful_sentences():
    text = "# Head\nDr. Smith paid 3.5 million. He left! was it so? Yes.\n```\ncode. Here.\n```\n- a bullet. Two\n12. item\n\nJ. Doe came. End"
    assert split_sentences(text) == ["Dr. Smith paid 3.5 million.", "He left! was it so?", "Yes.", "- a bullet. Two", "12. item", "J. Doe came.", "End"]
    assert split_sentences("") == []


def test_simple_sentences():
    assert simple_sentences('He said "no." Then (why?) he left. 3.5 is') == ['He said "no."', "Then (why?)", "he left.", "3.5 is"]


def test_long_paragraphs_split_in_linear_time():
    assert len(split_sentences("Go on. " * 50_000)) == 50_000
    began = time.perf_counter()
    for text in ("A." * 100_000, "." * 100_000 + "A", "'.A" * 50_000):
        assert "".join(split_sentences(text)) == text
    assert time.perf_counter() - began < 20  # a second on an idle machine; minutes where every mark walks back
