"""Spelling variants against brute force: words, edits by deletion neighbourhoods, forms and roots."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import spelling
from plumbline.llm.queries import op11_spelling_variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def near_by_hand(words):
    """Words share what is left without one letter, or one of them is that; each pair is then looked at in full."""
    meet = defaultdict(set)
    for w in words:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + w[i + 1 :]].add(w)
    out = defaultdict(set)
    for group in meet.values():
        for a, b in itertools.permutations(group, 2):
            if one_edit(a, b):
                out[a].add(b)
    return out


def by_hand(rows, least_n=3):
    n = {w: c for w, c in words_by_hand(rows).items() if c >= least_n}
    near, form = near_by_hand(n), {}
    for w in n:
        best = min(((-n[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def rows_of(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_documents_as_by_hand(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(op11_spelling_variants(spark, sf_dir))
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)
    assert sum(r[1] is not None for r in got) > 10


def test_crc_of_joined_texts():
    rnd = np.random.default_rng(3)
    firsts = [bytes(rnd.integers(0, 256, int(rnd.integers(0, 20)), np.uint8)) for _ in range(300)]
    seconds = [bytes(rnd.integers(0, 256, int(rnd.integers(1, 300)), np.uint8)) for _ in range(300)]
    got = spelling._crc_joined(np.array([zlib.crc32(a) for a in firsts], np.uint32), np.array([zlib.crc32(b) for b in seconds], np.uint32), np.array([len(b) for b in seconds]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(firsts, seconds, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(23)), st.lists(st.tuples(*[st.integers(0, 23)] * 4), max_size=8))
def test_wavelet_tree_reports_rectangles(values, boxes):
    tree = spelling.WaveletTree(np.array(values))
    x1, x2, y1, y2 = (np.array([b[i] for b in boxes], np.int64) for i in range(4))
    got = sorted(zip(*[x.tolist() for x in tree.report(x1, x2, y1, y2)], strict=True))
    assert got == sorted((q, v) for q, (a, b, c, d) in enumerate(boxes) for v in values[a:b] if c <= v < d)


@pytest.mark.parametrize("most", [20_000, 4])
def test_near_words_in_crowded_groups(spark, most):
    """Words of few letters, so that groups are large; with most = 4 their ranges are halved down to single positions."""
    rnd = np.random.default_rng(11)
    words = sorted({"".join(rnd.choice(list("abé"), int(rnd.integers(1, 8)))) for _ in range(600)} | {"b" * 300, "b" * 301, "b" * 150 + "a" + "b" * 150})
    got = spelling.near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long"), most=most, part_letters=2000).collect()
    want = near_by_hand(words)
    assert len(got) == sum(map(len, want.values())) and {(r["word"], r["near"]) for r in got} == {(a, b) for a in want for b in want[a]}
    assert all(words[r["n"]] == r["word"] and words[r["m"]] == r["near"] for r in got)


def test_chains_of_forms_lead_to_their_last(spark):
    words = {"aaaaaaaaaaaa"[:k] + "bcdefg": 3 * 2**k for k in range(9)}  # each form is twice as frequent and one letter longer
    text = " ".join(f"{w} " * n for w, n in words.items())
    got = {r[0]: r for r in rows_of(spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), every=1 << 31))}
    assert {r[2] for r in got.values()} == {"aaaaaaaabcdefg"} and got["bcdefg"][1] == "abcdefg"
    assert got["aaaaaaaabcdefg"][1] is None and got["bcdefg"][4:] == (1, 6)


def test_odd_rows(spark):
    long = " ".join(f"Wort{'abcdefghij'[i % 10]}lange" for i in range(30_000)) + " " + "x" * 70_000
    rows = [(None, "naïve NAÏVE naïve"), (1, None), (2, ""), (3, " 12 _ "), (4, "naïve×÷ Éclair éclair éclair éclair"), (4, "naïve×÷ Éclair éclair éclair éclair"), (5, long), (6, "x" * 70_000 + " " + "x" * 70_001), (7, "x" * 70_001 + " " + "x" * 70_001 + " " + "x" * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "n", "key", "meet", "length")})
    got = rows_of(spelling.variants(df))
    assert len(got) == len(set(got)) and set(got) == by_hand(rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(spelling.variants(empty)) == [] and rows_of(spelling.variants(spark.createDataFrame([(1, "one two")], "doc_id long, text string"))) == []
