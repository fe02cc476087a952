"""Stems against known ones, search texts, ranks against a plain count of minimal windows, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import plumbline.registry  # noqa: F401
from plumbline.functions.stems import stem
from plumbline.operators import fulltext as X

STEMS = """consign consign consigned consign consignment consign consistency consist consolations consol consolatory consolatori conspicuous conspicu conspiracy conspiraci constancy constanc knackeries knackeri knavish knavish
    kneaded knead kneel kneel knitted knit knives knive caresses caress ponies poni ties tie cats cat gas gas this this gaps gap kiwis kiwi agreed agre feed feed plastered plaster bled bled motoring motor sing sing hopping hop hoping hope
    falling fall hissing hiss filing file happy happi sky sky cry cri by by say say relational relat conditional condit rational ration valency valenc digitizer digit conformably conform radically radic differently differ vilely vile
    analogously analog vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope formality formal sensibility sensibl triplicate triplic formative format electricity electr electrical electr goodness good
    revival reviv allowance allow airliner airlin gyroscopic gyroscop adjustable adjust irritant irrit replacement replac adoption adopt communism communism activate activ effective effect bowdlerize bowdler probate probat rate rate
    cease ceas controlling control rolling roll generously generous communication communic dying die skies sky news news proceed proceed inning inning youth youth boys boy early earli securities secur biology biolog fluently fluentli""".split()


def test_known_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = spark.createDataFrame(pairs, "w string, want string").select("w", "want", stem(F.col("w")).alias("got")).where("NOT got <=> want").collect()
    assert got == [] and len(pairs) > 80
    assert spark.range(1).select(stem(F.lit(None).cast("string"))).first()[0] is None


def test_search_texts(spark):
    asked = [(1, 'the Bonds "proposal of the bonds" -bid'), (2, "a or -b"), (3, None), (4, ""), (5, "the of"), (6, "421.03 or well-known OR x"), (7, '"" - or "un closed')]
    got = {}
    for r in X.search_terms(spark.createDataFrame(asked, "query_id int, query string")).collect():
        got.setdefault(r["query_id"], set()).add((r["alt"], r["item"], r["without"], r["off"], r["lexeme"], r["n_off"], r["last_off"], r["n_items"]))
    assert got[1] == {(0, 1, False, 0, "bond", 1, 0, 2), (0, 2, False, 0, "propos", 2, 3, 2), (0, 2, False, 3, "bond", 2, 3, 2), (0, 3, True, 0, "bid", 1, 0, 2)}
    assert got[6] == {(0, 0, False, 0, "421.03", 1, 0, 1), (1, 2, False, 0, "well", 2, 1, 1), (1, 2, False, 1, "known", 2, 1, 1), (2, 4, False, 0, "x", 1, 0, 1)}
    assert got.keys() == {1, 6, 7} and {x[4] for x in got[7]} == {"un", "close"}


def by_hand(words, alternatives):
    """The rank by its definition: words of a text, alternatives as lists of phrases (lists of words); no stop words."""
    n, asked = len(words), {w for a in alternatives for p in a for w in p}
    entries = [i for i in range(n) if words[i] in asked]
    fits = [a for a in alternatives if all(any(words[i : i + len(p)] == p for i in range(n)) for p in a)]
    if not fits:
        return None

    def holds(lo, hi):
        return any(all(any(words[i : i + len(p)] == p and i + len(p) - 1 <= hi for i in range(lo, hi + 1)) for p in a) for a in fits)

    windows = [(a, b) for a in entries for b in entries if a <= b and holds(a, b)]
    least = [w for w in windows if not any(v != w and w[0] <= v[0] and v[1] <= w[1] for v in windows)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= e <= b for e in entries) - 1)) for a, b in least)


@pytest.mark.parametrize("seed", range(3))
def test_ranks_by_minimal_windows(spark, seed):
    rnd = np.random.default_rng(seed)
    letters = ["zab", "zeb", "zib", "zob", "zub", "zyb"]
    docs = [(i, [str(w) for w in rnd.choice(letters, int(rnd.integers(0, 14)))]) for i in range(120)]
    asks = {
        1: ("zab zeb", [[["zab"], ["zeb"]]]), 2: ("zab or zeb zib", [[["zab"]], [["zeb"], ["zib"]]]), 3: ('"zab zeb"', [[["zab", "zeb"]]]), 4: ('"zab zeb" zib or zob zub', [[["zab", "zeb"], ["zib"]], [["zob"], ["zub"]]]),
        5: ("zab zab", [[["zab"], ["zab"]]]), 6: ('zab "zab zeb zab"', [[["zab"], ["zab", "zeb", "zab"]]]), 7: ("zab zeb zib zob", [[["zab"], ["zeb"], ["zib"], ["zob"]]]),
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id int, text string")
    index = X.positions(df)
    got = {(r["query_id"], r["id"]): r["rank_score"] for r in X.search(index, X.search_terms(spark.createDataFrame([(k, q) for k, (q, _) in asks.items()], "query_id int, query string")), None).collect()}
    want = {(k, i): s for k, (_, a) in asks.items() for i, w in docs if (s := by_hand(w, a)) is not None}
    assert got.keys() == want.keys() and got == pytest.approx(want)
    top = X.search(index, X.search_terms(spark.createDataFrame([(1, "zab -zeb")], "query_id int, query string")), 3, few=0).collect()
    own = sorted(((-by_hand(w, [[["zab"]]]), i) for i, w in docs if "zab" in w and "zeb" not in w))[:3]
    assert [(r["id"], r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [(i, k + 1) for k, (_, i) in enumerate(own)]


def test_odd_texts(spark):
    rows = [(None, "alpha beta"), (1, None), (2, ""), (3, "the of"), (4, "Alpha ALPHAS alpha's"), (4, "alpha"), (5, "x " * 30_000 + "alpha")]
    index = X.positions(spark.createDataFrame(rows, "doc_id int, text string"))
    at = {(r["id"], r["lexeme"]): r["positions"] for r in index.collect()}
    assert at[5, "alpha"] == [30_001] and at[4, "alpha"][0] == 1 and (3, "the") not in at
    found = X.search(index, X.search_terms(spark.createDataFrame([(1, "alpha")], "query_id int, query string")), None).collect()
    assert {r["id"] for r in found} == {None, 4, 5} and all(x >= 0 for r in found for x in [r["rank_score"]])
    only = X.search(X.within(index, spark.createDataFrame([(5,), (None,)], "doc_id int")), X.search_terms(spark.createDataFrame([(1, "alpha")], "query_id int, query string")), 8)
    assert [r["id"] for r in only.collect()] == [5]
    assert list(itertools.chain(X.search(index.limit(0), X.search_terms(spark.createDataFrame([(1, "alpha")], "query_id int, query string"))).collect())) == []


def test_index_of_what_is_asked(spark):
    """Only the lexemes asked for are placed, and a query of a frequent and a rare word reads places only where both stand."""
    rows = [(i, "bonds " * 3 + ("permits bond" if i == 7 else "filler")) for i in range(40)] + [(None, "permit bonds"), (90, "permit")]
    docs, terms = spark.createDataFrame(rows, "doc_id int, text string"), X.search_terms(spark.createDataFrame([(1, "permit bond"), (None, "permit bond or nowhere"), (3, "bond nowhere")], "query_id int, query string"))
    whole, asked = X.positions(docs), X.positions(docs, asked=terms)
    assert {r["lexeme"] for r in asked.collect()} == {"bond", "permit"}
    assert sorted(map(repr, whole.where("lexeme IN ('bond', 'permit')").collect())) == sorted(map(repr, asked.collect())) == sorted(map(repr, X.positions(docs, asked=terms, few=0).collect()))
    one, two = (sorted(map(repr, X.search(x, terms, None).select("query_id", "id", "rank", "rank_score").collect())) for x in (whole, asked))
    assert one == two and len(one) == 4
    plan = X.search(asked, terms, None)._jdf.queryExecution().toString()
    assert "array_except" in plan


def test_places_are_not_shuffled(spark):
    """The whole index deals texts by id and nothing after: places and words stay where their text is."""
    plan = X.positions(spark.createDataFrame([(1, "a bond")], "doc_id int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
