import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm.bpe import Vocabulary, build_lexicon, decode_documents, encode_documents, round_trips
from factloom.llm.decontaminate import contaminated, decontaminated, distance_within
from factloom.llm.langid import held_out, identify
from factloom.llm.quality import score_quality
from factloom.llm.queries import tokenizer
from factloom.llm.sharding import minimax_shards
from factloom.llm.token_counts import attribute, token_counts
from factloom.llm.url_filter import judge_urls, links_of

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ODD = ["", None, "a", "<|endoftext|>x <|endoftext|>", "  two  spaces\n\n\tand 123's it'll ", "é漢字🙂 ½²Ⅷ ٣ a​b", "\x1c\x85\xa0 ", "w" * 5000, "'" * 70, "x<|endoftext|", " " * 300 + "end"]


@pytest.mark.parametrize("words", [0, 3, 65_536])
def test_bpe_matches_the_library(documents, words):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = list(enumerate([*ODD, ODD[4], "the cat and the dog " * 9])) + [(None, "no id")]
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = [tuple(r) for r in round_trips(documents(rows), path, lexicon_words=words).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert round_trips(documents([]), path).count() == 0


def test_ids_decode_to_the_texts(spark, documents):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = list(enumerate(ODD)) + [(1, "an id again"), (None, "no id"), (None, "no id")]
    ids = encode_documents(documents(rows), path)
    assert sorted(((r.doc_id, r.n_tokens, r.ids) for r in ids.collect()), key=repr) == sorted(((i, len(e), e) for i, x in rows for e in [t.encode(x or "", add_special_tokens=False).ids]), key=repr)
    assert sorted(((r.doc_id, r.text) for r in decode_documents(ids, path).collect()), key=repr) == sorted(((i, x or "") for i, x in rows), key=repr)
    odd = [[], None, [0], t.encode("é", add_special_tokens=False).ids[:1], list(range(600))]
    got = decode_documents(spark.createDataFrame(list(enumerate(odd)), "doc_id long, ids array<int>"), path).collect()
    assert {r.doc_id: r.text for r in got} == {k: None if o is None else t.decode(o, skip_special_tokens=False) for k, o in enumerate(odd)}
    assert decode_documents(encode_documents(documents([]), path), path).count() == 0


def test_lexicon_shares_endings_and_knows_places():
    words = {w.encode(): [k] for k, w in enumerate(["tap", "taps", "top", "tops", "s", ""])}
    from factloom.llm.bpe import Lexicon

    lexicon = Lexicon(build_lexicon(words))
    assert [lexicon.ids_at(p) for p in lexicon.places(sorted(words))] == [words[w] for w in sorted(words)]
    assert lexicon.places([b"ta", b"tapss", b"x"]).tolist() == [-1, -1, -1]
    assert len(lexicon.final) <= 6


def test_batch_merges_match_single_ones():
    v, rng = Vocabulary(tokenizer("byte_bpe_50k.json")), random.Random(8)
    words = ["".join(rng.choices(" abcdethnrsé\n", k=rng.randrange(1, 30))).encode() for _ in range(400)]
    assert v.merge_all(words) == [v.merge(w) for w in words]
    long = ("ab" * 300).encode()
    assert v.merge(long) == v.merge_all([long])[0]


def test_token_counts_add_up(documents):
    import tiktoken

    from factloom.llm.bpe import PATTERN
    from factloom.llm.token_counts import read_ranks

    path = tokenizer("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rows = [(1, "one line\n\n  and another\nlast"), (2, None), (3, ""), (4, "\n"), (5, "é漢字\n🙂x"), (5, "again"), (None, "z" * 2000)]
    for rule in ("start", "end", "majority"):
        got = token_counts(documents(rows), path, rule=rule).collect()
        for i, text in rows:
            mine = [r for r in got if r.doc_id == i and r.doc_tokens == len(encoding.encode_ordinary(text or ""))]
            assert mine and sum(r.n_tokens for r in mine) == mine[0].doc_tokens and sum(r.n_bytes for r in mine) == len((text or "").encode())
    assert token_counts(documents([]), path).count() == 0


def test_sections_get_what_a_plain_count_gives(documents):
    """Each token is laid over the bytes of the text, one byte after another, and asks the section of the byte that the rule names."""
    import tiktoken

    from factloom.llm.bpe import PATTERN
    from factloom.llm.token_counts import read_ranks

    path = tokenizer("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rng = random.Random(5)
    texts = ["one line\n\n  and another\nlast", "", "\n", "\n\n\n\n x \n\n", "é漢字\n🙂x\n", "z" * 300, *("".join(rng.choices("ab \n\né.", k=rng.randrange(90))) for _ in range(25))]
    rows = list(enumerate(texts))
    for rule in ("start", "end", "majority"):
        want = []
        for i, text in rows:
            raw, section_of, k = text.encode(), [], 0
            for j, byte in enumerate(raw):
                section_of.append(k)
                k += byte == 10 and j + 1 < len(raw)
            tokens, crossing, at = [0] * (k + 1), [0] * (k + 1), 0
            for t in encoding.encode_ordinary(text):
                own = section_of[at : at + len(encoding.decode_single_token_bytes(t))]
                at += len(own)
                s = {"start": own[0], "end": own[-1], "majority": max(sorted(set(own)), key=own.count)}[rule]
                tokens[s] += 1
                crossing[s] += own[0] != own[-1]
            want += [(i, s, section_of.index(s) if raw else 0, section_of.count(s), tokens[s], crossing[s], sum(tokens)) for s in range(k + 1)]
        assert sorted(tuple(r) for r in token_counts(documents(rows), path, rule=rule).collect()) == want


def test_kernel_scores_match_a_dense_version():
    """Presence of every n-gram as a set, kernel and Nystroem features by their formulas, ridge regression by least squares."""
    from factloom.llm import langid as L

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeé xyz" if k % 2 else "ghijkl mnö", k=rng.randrange(3, 60))) + " " + rng.choice("pq") for k in range(40)]
    langs = ["one" if k % 2 else "two" for k in range(40)]
    model = L.fit(texts, langs, landmarks=10, ridge=1e-2)
    clean = lambda t: bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in t.lower().encode())
    sets = lambda t: {clean(t)[k : k + n] for n in (1, 2, 3) for k in range(len(clean(t)) - n + 1)}
    kernel = lambda p, q: np.array([[len(sets(a) & sets(b)) / (len(sets(a)) * len(sets(b))) ** 0.5 for b in q] for a in p])
    draw = np.random.default_rng(0)
    marks = [texts[k] for k in np.sort(np.concatenate([draw.permutation([k for k in range(40) if langs[k] == x])[:5] for x in ("one", "two")]))]
    new = ["abc xyz", "ghi", "Q!", "é"]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    root = vectors / np.sqrt(values)
    phi, y = kernel(texts, marks) @ root, np.array([[1 if x == a else -1 for a in ("one", "two")] for x in langs])
    a = np.vstack([np.hstack([phi, np.ones((40, 1))]) / 40**0.5, np.hstack([np.eye(len(marks)) * 1e-2**0.5, np.zeros((len(marks), 1))])])
    beta = np.linalg.lstsq(a, np.vstack([y / 40**0.5, np.zeros((len(marks), 2))]), rcond=None)[0]
    want = kernel(new, marks) @ root @ beta[:-1] + beta[-1]
    for _, _, data, offsets in L._blocks(pa.array(new)):
        assert np.allclose(model.scores(model.kernel(data, offsets, L.Distinct())), want, atol=2e-3)


def test_repeated_rows_are_learned_once(documents):
    train = documents([(1, "der die das", "de")] * 50 + [(2, "the and of", "en")] * 3)
    from factloom.llm.langid import sample

    assert sorted(tuple(r) for r in sample(train.select("doc_id", "lang"), "lang", 10).collect()) == [(1, "de"), (2, "en")]
    assert {r.doc_id: r.lang_pred for r in identify(documents([(7, "das die"), (8, "of the")]), train).collect()} == {7: "de", 8: "en"}


def test_attribution_rules():
    ends, bounds = np.array([2, 5, 9]), np.array([0, 3, 8, 9])
    assert attribute(ends, bounds, "start")[0].tolist() == [2, 1, 0]
    assert attribute(ends, bounds, "end")[0].tolist() == [1, 1, 1]
    assert attribute(ends, bounds, "majority")[0].tolist() == [1, 2, 0]
    assert attribute(ends, bounds, "start")[1].tolist() == [1, 1, 0]


def least_capacity(sizes, shards):
    low, high = max([*sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid, used, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                used, held = used + 1, 0
            held += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_shards_have_the_least_capacity(documents, digits):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(1, 60) + str(rng.randrange(150))) for i in range(400)] + [(400, None), (401, ""), (401, ""), (None, "y")]
    got = minimax_shards(documents(rows), shards=7, digits=digits).collect()
    assert len(got) == len(rows)
    by_key, bytes_of = {}, {}
    for r in got:
        bytes_of[r.shard] = bytes_of.get(r.shard, 0) + r.size
    for i, t in rows:
        key = hashlib.sha256((t or "").encode()).hexdigest()
        by_key[key] = by_key.get(key, 0) + len((t or "").encode()) + 8
    assert max(bytes_of.values()) == least_capacity([by_key[k] for k in sorted(by_key)], 7)
    texts = {}
    for r in got:
        t = dict(rows).get(r.doc_id) or ""
        assert r.text_crc32 == zlib.crc32(t.encode()) and r.size == len(t.encode()) + 8
        texts.setdefault(t, set()).add(r.shard)
    assert all(len(s) == 1 for s in texts.values())
    for s in set(bytes_of):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_a_hot_group_has_its_own_shard(documents):
    rows = [(i, "hot " * 20) for i in range(200)] + [(1000 + i, f"text {i}") for i in range(200)]
    got = minimax_shards(documents(rows), shards=5).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    assert len(sizes) == 5 and sorted(map(len, sizes.values()))[-1] == 200
    loose = sorted(sum(r.size for r in v) for v in sizes.values())[:-1]
    assert max(loose) <= 1.2 * min(loose)
    assert minimax_shards(documents([])).count() == 0 and "Python" not in minimax_shards(documents(rows))._jdf.queryExecution().toString()


def test_urls_with_aliases_and_precedence(spark):
    page = lambda i, url, to=None, how="canonical": (i, url, f'<link rel="canonical" href="{to}">' if to and how == "canonical" else f'<meta http-equiv="refresh" content="0; url={to}">' if to else None)
    rows = [
        page(1, "http://A.net/x"), page(2, "https://alias.com/y?q#f", "http://a.net/x"), page(3, "http://third.com/z", "https://alias.com/y", "refresh"),
        page(4, "http://sub.example.net/en/p"), page(5, "http://example.com/de/1"), page(6, "http://free.org/fr/1", "http://example.com/de/1"),
        page(7, "http://other.com/q", "http://free.org/fr/1"), page(8, None), page(9, "no scheme"), page(10, "http://b.net"), page(11, "http://net/"),
        page(12, "http://rel.com/a", "/b"), page(13, "http://rel.com/b"), page(1, "http://A.net/x"),
    ]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, rule string, node string")
    got = sorted({tuple(r) for r in judge_urls(pages, links=links_of(pages)).collect()}, key=repr)
    verdict = {r[0]: r[4] for r in got}
    assert {k: v for k, v in verdict.items() if v == "block"} == {k: "block" for k in (1, 2, 3, 5, 11)}
    rules = {r[0]: r[3] for r in got if r[3]}
    assert rules == {1: "net/", 4: "example.net/en/", 5: "example.com/de/", 6: "org/fr/", 11: "net/"}
    many = [("block", f"h{k}.io", "/") for k in range(300)] + [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    assert sorted({tuple(r) for r in judge_urls(pages, many, links_of(pages)).collect()}, key=repr) == got
    assert judge_urls(pages.limit(0), links=links_of(pages.limit(0))).count() == 0


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def test_myers_matches_the_table():
    rng = random.Random(6)
    for _ in range(300):
        p, t = bytes(rng.choices(b"abc", k=rng.randrange(1, 12))), bytes(rng.choices(b"abc", k=rng.randrange(0, 25)))
        masks = {}
        for i, b in enumerate(p):
            masks[b] = masks.get(b, 0) | 1 << i
        want = edit_distance(p, t)
        assert distance_within(masks, len(p), t, 4) == (want if want <= 4 else None)


def test_leaks_match_brute_force(spark, documents):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tur", "es") for b in ("n", "ra", "v", "dox")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(8, 30))).capitalize() + ".") for i in range(12)] + [(90, None), (91, ""), (92, "tiny"), (0, "A repeated id with some other text, long enough")]
    docs = [(1, None), (2, ""), (3, "TINY!"), (4, "tiny but more"), (5, "so tiny, tiny"), (6, "destiny"), (7, "tinya"), (None, "tiny"), (4, "tiny but more"), (8, "x " * 40_000 + "tiny")]
    for i in range(40):
        text = list(rng.choice([t for _, t in items if t]))
        for _ in range(rng.choice([0, 0, 2, 5, 12])):
            text[rng.randrange(len(text))] = rng.choice("xyz ")
        docs.append((10 + i, " ".join(rng.choices(words, k=9)) + " " + "".join(text).upper() + "\n" + " ".join(rng.choices(words, k=9))))
    plain = lambda t: " ".join(re.sub("[^0-9a-z\x80-\U0010ffff]", " ", (t or "").lower()).split())
    want = []
    for d, text in docs:
        for i, item in items:
            a, b = plain(item), plain(text)
            if 0 < len(a) < 20:  # no edit is allowed: whole words
                want += [(d, i, 0)] if f" {a} " in f" {b} " else []
            elif a and b and len(b) < 9000 and (k := edit_distance(a.encode(), b.encode())) <= int(len(a) * 0.05):
                want.append((d, i, k))
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    assert any(k for *_, k in want) and any(not k for *_, k in want)
    for block in (16 << 20, 200):
        assert sorted((tuple(r) for r in contaminated(documents(docs), bench, block_bytes=block).collect()), key=repr) == sorted(want, key=repr)
        rows = decontaminated(documents(docs), bench, block_bytes=block)
        leaked = {d for d, *_ in want}
        assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=repr) == sorted((x for x in docs if x[0] not in leaked), key=repr)
        assert rows.columns == documents([]).columns
    assert contaminated(documents(docs), bench.limit(0)).count() == 0 and contaminated(documents([]), bench).count() == 0


def test_language_on_held_out_documents(spark, rows_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs, docs.where(~held_out("doc_id", 4, 2))).join(docs.select("doc_id", "lang"), "doc_id").where(held_out("doc_id", 4, 2)).collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_rows(documents):
    train = documents([(i, "der die das und nicht ein", "de") for i in range(9)] + [(20 + i, "the and of with that", "en") for i in range(9)] + [(50, None, "en"), (51, "x", None)])
    got = {r.doc_id: r.lang_pred for r in identify(documents([(1, None), (2, ""), (3, "123 !?"), (4, "UND NICHT DAS"), (5, "the of and " * 9000), (None, "with that")]), train).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "de", 5: "en", None: "en"}
    assert [r.lang_pred for r in identify(documents([(1, "word")]), train.limit(0)).collect()] == ["und"]
    assert identify(documents([]), train).count() == 0


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label")
    out = score_quality(docs, labels.where(~held_out("doc_id", 3, 1))).join(labels, "doc_id").where(held_out("doc_id", 3, 1)).collect()
    assert len(out) > 100 and sum(r.label == r.predicted for r in out) >= 0.95 * len(out)


def test_quality_of_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "a " * 30_000), (4, "Fine words here."), (4, "Fine words here."), (None, "x%%% y$$$")])
    labels = spark.createDataFrame([(4, 1), (3, 0), (4, None), (99, 1), (None, 0)], "doc_id long, label int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in score_quality(docs, labels.where("label = 1")).collect()} == {0.5}
    assert score_quality(documents([]), labels).count() == 0
