"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe, components, curves, gated, line_runs, lsh_forest, media, packing, pages, prefix_free, sharding, shingles
from plumbline.llm.common import byte_view
from plumbline.llm.queries import byte_bpe_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "one", "en", "b", 3), (6, LONG, "de", "a", len(LONG)),
    (7, "é漢字 😀 don't  stop\n\nnow", None, "b", 9), (None, "no key here at all, none", "en", None, None), (4, "one", "en", "a", 3), (8, "<|endoftext|> x", "fr", "c", 15),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def clashing(df, *names):
    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df


# 1


def test_hilbert_neighbours_are_adjacent_cells():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = sharding.hilbert_index(cells, 3)
    assert sorted(at) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_shards_are_even_and_gapless(spark, docs, odd, empty):
    for df, n in ((docs, 24), (clashing(odd, "row", "slot", "shard"), 3), (odd, 24)):
        out = sharding.curve_shards(df, n).collect()
        assert len(out) == df.count()
        slots = defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[i]) for i in range(n)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.curve_shards(odd, 3).collect()}
    assert got == {(i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in ODD}
    assert sharding.curve_shards(empty, 24).count() == 0


def test_bounds_prune_shards(spark, docs):
    shards = sharding.curve_shards(docs, 24)
    bounds = sharding.shard_bounds(shards)
    hit = sharding.shards_for(bounds, lang=("fr", "fr"), size=(0, 600))
    need = {r["shard"] for r in shards.where("lang = 'fr' AND size <= 600").collect()}
    assert need <= {r["shard"] for r in hit.collect()} and hit.count() < 24


# 2


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 3]), st.sampled_from(["none", "adaptive"]), st.integers(0, 9999))
def test_png_round_trip(h, w, channels, filters, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, channels) if channels > 1 else (h, w), np.uint8)
    assert (media.decode_png(media.encode_png(x, filters=filters)) == x).all()


def test_damaged_png_is_refused():
    data = bytearray(media.encode_png(np.arange(64, dtype=np.uint8).reshape(8, 8)))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError):
        media.decode_png(bytes(media.encode_png(np.zeros((2, 2), np.uint8)))[:-6])


def test_text_images(spark, odd, empty):
    out = media.with_image_features(media.with_text_image(clashing(odd.select("doc_id", "text"), "media", "n_bytes", "feature", "note"))).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    for i, t, *_ in ODD:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert by[4]["media_sha256"] == by[5]["media_sha256"] and by[4]["feature"] == by[5]["feature"]
    assert media.with_image_features(media.with_text_image(empty)).count() == 0


def test_feature_is_a_cosine_transform():
    x = np.random.default_rng(5).integers(0, 256, (70, 64)).astype(np.float64)
    band = lambda a: np.array([a[i * len(a) // 32 : (i + 1) * len(a) // 32].mean(0) for i in range(32)])
    small = band(band(x).T).T
    wave = lambda u, i: np.cos(np.pi * u * (2 * i + 1) / 64)
    low = np.array([sum(small[i, j] * wave(u, i) * wave(v, j) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)])
    bits = "".join("1" if c > np.median(low[1:]) else "0" for c in low)
    assert media.cosine_hash(x.astype(np.uint8)) == f"{int(bits, 2):016x}"


# 3


def shingle_set(text, width=5):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    ws = low.translate(bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))).split(b" ")
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else ({tuple(ws)} if ws else set())


def near_by_force(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = Counter((a, b) for v in by.values() for a in v for b in v if a < b)
    for (a, b), both in seen.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return [(k, len(s), min((x for x in least[find(i)] if x is not None), default=None)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def test_near_duplicates_match_brute_force(spark, docs, rows):
    out = lsh_forest.near_duplicates(docs, percent=85)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == sorted(near_by_force(rows, 85))


def test_near_duplicates_of_a_family_with_one_common_original(spark):
    rnd = np.random.default_rng(1)
    base = [f"w{x}" for x in rnd.integers(0, 5000, 300)]
    made = [(0, " ".join(base))]
    for i in range(1, 120):
        own = list(base)
        for j in rnd.integers(0, 300, 6):
            own[j] = f"v{i}x{j}"
        made.append((i, " ".join(own)))
    made += [(i + 500, " ".join(f"u{x}" for x in rnd.integers(0, 5000, 60))) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(df, percent=85).collect()}
    assert got == {k: c for k, _, c in near_by_force(made, 85)}


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    out = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in lsh_forest.near_duplicates(clashing(odd, "node", "a", "b")).collect()]
    assert len(out) == len(ODD)
    assert {x for x in out if x[0] in (1, 2, 3, 4, 5)} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)}
    assert [x[3] for x in out if x[0] is None] == [False]
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


# 4


def test_toxicity_learns_and_keeps_rows(spark, odd, empty):
    rnd = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(300):
        ws = [f"w{x}" for x in rnd.integers(0, 400, rnd.integers(20, 150))]
        if i % 2:
            ws[rnd.integers(0, len(ws))] = ["vilest", "rotten", "viler"][i % 3]
        texts.append(" ".join(ws))
        labels.append(i % 2)
    net = gated.train(texts[:240], labels[:240])
    df = spark.createDataFrame(list(enumerate(texts[240:])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in gated.with_toxicity(df, net).collect()}
    right = sum((got[i] >= 0.3) == bool(y) for i, y in enumerate(labels[240:]))
    assert right >= 55
    out = gated.with_toxicity(clashing(odd, "score"), net).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    assert gated.with_toxicity(empty, net).count() == 0


def test_texts_without_words_get_the_true_share_and_stay(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from plumbline.llm import queries

    schema = "doc_id long, text string"
    made = [(k, ("vile rotten words" if k % 4 == 0 else "quite clean words") + f" of text {k}") for k in range(40)]
    spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, int(k % 4 == 0)) for k in range(40)] + [(k, int(k % 50 == 0)) for k in range(100, 900)] + [(None, 1), (7000, None)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    fit = [y for k, y in labels if k is not None and y is not None and not gated.is_held_out(k)]
    net = queries.toxicity_model(spark, str(tmp_path))
    assert abs(net.prior - sum(fit) / len(fit)) < 1e-9
    net.prior = 0.5
    monkeypatch.setattr(corpus_pipeline, "toxicity_model", lambda *_: net)
    texts = [None, "", " ", "\n\n", "\t\r\n", "--- !?", "\x00"]
    bare = spark.createDataFrame(list(enumerate(texts)), schema)
    assert corpus_pipeline.toxicity(spark, bare, "").count() == len(texts)
    words = ["a", "'", "7", "é", "\u00a0", " x "]
    assert spark.createDataFrame(list(enumerate(words)), schema).where(gated.has_words(F.col("text"))).count() == len(words)
    assert (gated.tokens_of(*byte_view(pa.array(words)), gated.Shape()).found > 0).all() and not gated.tokens_of(*byte_view(pa.array(texts, pa.string())), gated.Shape()).found.any()


def test_network_gradients():
    shape = gated.Shape(window=5, stride=3, word_rows=16, gram_rows=32, width=3, hidden=2)
    net = gated.Network(shape)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = gated.tokens_of(*byte_view(pa.array(["ab cd ef gh ij kl", "x"])), shape)
    x, y = net.vectors(t).astype(np.float64), np.arange(len(t.windows)) % 2

    def loss():
        z = net.forward(x, t.windows)
        return float((np.log1p(np.exp(z)) - y * z).sum())

    kept = {}
    z = net.forward(x, t.windows, kept)
    g, back = net.backward(x, t.windows, kept, 1 / (1 + np.exp(-z)) - y)
    for name in ("Wf", "Ub", "cf", "A", "v", "w"):
        flat = net.p[name].reshape(-1)
        for i in (0, len(flat) - 1):
            flat[i] += 1e-4
            up = loss()
            flat[i] -= 2e-4
            down = loss()
            flat[i] += 1e-4
            assert abs((up - down) / 2e-4 - g[name].reshape(-1)[i]) < 1e-2 * max(1, abs(g[name].reshape(-1)[i]))


# 5


def test_neighbours_reach_their_recall(spark):
    rnd = np.random.default_rng(2)
    v = rnd.standard_normal((1500, 24)) + 3 * rnd.standard_normal((15, 24))[rnd.integers(0, 15, 1500)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    out = curves.nearest(df, F.col("vec_id") % 25 == 0, 10, block=128).collect()
    hits, by = 0, defaultdict(dict)
    for r in out:
        by[r["query_id"]][r["vec_id"]] = (r["rank"], r["score"])
    for q in range(0, 1500, 25):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & set(by[q]))
        assert sorted(x[0] for x in by[q].values()) == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-9 for i, (_, s) in by[q].items())
    assert hits >= 0.9 * 600


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [0.0, 1.0]), (6, []), (7, [1.0, None]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r["query_id"], r["rank"], r["vec_id"]) for r in curves.nearest(clashing(df, "row", "v"), F.col("vec_id") == 5, 10).collect()]
    assert sorted(out) == [(5, 1, 0), (5, 2, 0), (5, 3, 1)]
    assert curves.nearest(df.limit(0), F.col("vec_id") == 5, 10).count() == 0


# 6


def lines_by_force(rows, min_words):
    """Deletes later copies: any run of lines that stood before, as long as it goes, with enough words."""
    place = [(k, i, x) for k, t in rows for i, x in enumerate(t.split("\n"))]
    flat = [x for *_, x in place]
    end = {}
    for p in range(len(place) - 1, -1, -1):
        end[p] = end[p + 1] if p + 1 < len(place) and place[p + 1][1] > 0 else p + 1
    gone = set()
    starts = defaultdict(list)
    for p, x in enumerate(flat):
        best = 0
        for q in starts[x]:
            n = 0
            while p + n < end[p] and q + n < end[q] and flat[q + n] == flat[p + n]:
                n += 1
            best = max(best, n)
        if sum(len(y.split()) for y in flat[p : p + best]) >= min_words:
            gone |= set(range(p, p + best))
        starts[x].append(p)
    return {(place[p][0], place[p][1]) for p in gone}


def test_line_runs_match_brute_force(spark):
    rnd = np.random.default_rng(3)
    pool = [f"line {i} has some seven words here" for i in range(30)] + ["x", "y z"]
    made = [(k, "\n".join(pool[i] for i in rnd.integers(0, 32, rnd.integers(1, 6))) + f"\nown {k} of one two three") for k in range(60)]
    made += [(100, made[0][1]), (101, "\n".join(["x"] * 40))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = lines_by_force(made, 7)
    out = {r["doc_id"]: r for r in line_runs.without_repeated_runs(df, min_words=7).collect()}
    for k, t in made:
        kept = [x for i, x in enumerate(t.split("\n")) if (k, i) not in want]
        assert out[k]["text"] == "\n".join(kept), k
    assert out[100]["text"] == ""


def test_line_runs_whose_parts_first_stand_elsewhere(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    made = [(0, f"{b}\n{c}"), (1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{c}\n\n"), (3, f"own\n{a}\n{b}\n{c}\n\nend"), (4, f"own too\n\n{c}")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for floor in (1, 4, 10):
        want = lines_by_force(made, floor)
        out = {r["doc_id"]: r["text"] for r in line_runs.without_repeated_runs(df, min_words=floor).collect()}
        assert out == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in want) for k, t in made}
        assert out[3] == "own\nend"


def test_line_runs_query_takes_short_lines(spark, tmp_path):
    from plumbline.llm.queries import op6_line_runs

    made = [(1, "own\nRead more\n\nx"), (2, "Read more\n\nother"), (3, "third\n\n\t\nRead more")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in op6_line_runs(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 2, 3: 1}


def test_line_runs_move_texts_alike_at_every_size(spark):
    made = [(k, f"same line\n\nown {k}") for k in range(20)]
    out = line_runs.without_repeated_runs(spark.createDataFrame(made, "doc_id long, text string"), min_words=1)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {k: 2 * (k > 0) for k, _ in made}


def test_line_runs_of_odd_rows(spark, odd, empty):
    out = line_runs.without_repeated_runs(clashing(odd, "gone", "own", "row", "n_lines"), min_words=1).collect()
    assert len(out) == len(ODD) and [r["text"] for r in out if r["doc_id"] == 1] == [None]
    assert sorted(r["text"] for r in out if r["doc_id"] in (4, 5)) == ["", "", "one"]
    assert line_runs.without_repeated_runs(empty).count() == 0


# 7

PAGE = """<html><head><title>T</title><script>if (a < b) "</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li>x</ul></nav>
<div class=promo-box>Our shop <b>opens</b></div><main><article><h1>A &amp; B</h1><p>First&nbsp;par  with <b>bold<br>line<p>Second <!-- no --> one<ul><li>i1<li>i2</ul>
<div class="share">share me</div><form><input>go</form><section id=comments><p>nice!</section></article></main><div>{t}</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    top = pages.parse(PAGE)
    assert pages.text_of(pages.article_of(top)) == "A & B\nFirst par with bold line\nSecond one\ni1\ni2"


def test_site_templates_go_and_article_lines_stay(spark):
    make = lambda i: f"<body><div><p>Our site, since 1990</p></div><div><h1>Title {i}</h1><p>the same first line</p><p>own text {i} goes on</p></div></body>"
    rows = [(i, f"http://user@a.example:80/{i}", make(i)) for i in range(20)] + [(98, None, None), (99, "http://b.example/", make(99)), (99, "http://b.example/", make(99))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = pages.main_text(clashing(df, "page", "gone", "text")).collect()
    got = defaultdict(list)
    for r in out:
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Title 3\nthe same first line\nown text 3 goes on"]
    assert got[98] == [""] and got[99] == ["Our site, since 1990\nTitle 99\nthe same first line\nown text 99 goes on"] * 2
    assert pages.main_text(df.limit(0)).count() == 0


def test_rare_templates_go_and_copies_of_an_article_stay(spark):
    story = lambda i: " ".join(f"own{i}x{j}" for j in range(40))
    make = lambda i, more="": f"<body><article><h1>T{i}</h1><p>{story(i)}</p>{more}</article></body>"
    note = "<div>call us now</div><figure>our shop</figure>"
    rows = [(i, f"http://a.example/{i}", make(i, note if i < 6 else "")) for i in range(60)]
    copy = "<body><article><div><p>first half of it all</p></div><section><p>second half</p></section></article></body>"
    rows += [(100 + i, f"http://b.example/{i}", copy) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert all(got[i] == f"T{i}\n{story(i)}" for i in range(60))
    assert all(got[100 + i] == "first half of it all\nsecond half" for i in range(8))


# 8


def check_packing(spark, df, texts):
    codec = bpe.codec_of(bpe.tokenizer_source(byte_bpe_path()))
    ids = [np.append(np.frombuffer(codec.encode([t or ""])[0], "<u4"), np.uint32(0)) for t in texts]
    out = packing.pack(df, byte_bpe_path(), capacity=64).collect()
    assert Counter((r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in out) == Counter(
        (len(x), a, n, zlib.crc32(x[a : a + n].astype("<u4").tobytes())) for x in ids for a, n in zip(np.cumsum([0, *packing.pieces_of(len(x), 64)[:-1]]).tolist(), packing.pieces_of(len(x), 64), strict=True)
    )
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0] + [n for _, n in v])[:-1].tolist() and sum(n for _, n in v) <= 64
    return sum(map(len, ids)) / (64 * len(bins))


def test_packing(spark, docs, rows, odd, empty):
    assert check_packing(spark, docs.repartition(3), [t for _, t in rows]) > 0.97
    check_packing(spark, clashing(odd, "key", "start"), [t for _, t, *_ in ODD])
    assert packing.pack(empty, byte_bpe_path()).count() == 0


def test_packing_query_against_the_library(spark, sf_dir, rows):
    from tokenizers import Tokenizer

    from plumbline.llm.queries import op8_harmonic_packing

    library = Tokenizer.from_file(byte_bpe_path())
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in op8_harmonic_packing(spark, sf_dir).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held, size in [*((pieces[k], len(x)) for k, x in ids.items()), *((v, None) for v in bins.values())]:
        held.sort()
        total = sum(n for _, n in held)
        assert [a for a, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist()
        assert total == size if size is not None else total <= 1024
    assert sum(map(len, ids.values())) >= 0.97 * 1024 * len(bins)


@given(st.integers(1, 10_000))
def test_pieces_cover_and_fill_their_class(n):
    parts = packing.pieces_of(n, 1024)
    assert sum(parts) == n and all(0 < p <= 1024 for p in parts)
    assert all((1024 // p) * p >= packing.FULL_ENOUGH * 1024 or p == 1024 // (1024 // p) for p in parts)


# 9


def repeats_by_force(texts, length):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]].append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for v in seen.values():
        if len(v) > 1:
            for d, i in v:
                gone[d][i : i + length] = True
    return [(len(t), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(np.int8)])) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[~g])) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("length, v", [(40, 20), (24, 9)])
def test_repeats_match_brute_force(spark, length, v):
    rnd = np.random.default_rng(length)
    word = lambda: "".join(rnd.choice(list("abcdé"), rnd.integers(1, 4)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(6)]
    texts = []
    for _ in range(150):
        parts = [" ".join(word() for _ in range(rnd.integers(0, 12)))]
        for _ in range(rnd.integers(0, 3)):
            s = shared[rnd.integers(0, 6)]
            a, b = sorted(rnd.integers(0, len(s), 2))
            parts += [s[a:b], word()]
        texts.append(" ".join(parts))
    texts += ["a" * 130, "ab" * 60, texts[0], texts[0], "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in prefix_free.without_repeats(df, length=length, k=6, v=v).collect()}
    assert [out[i] for i in range(len(texts))] == repeats_by_force([t.encode() for t in texts], length)


def test_repeats_of_odd_rows(spark, odd, empty):
    out = prefix_free.without_repeats(clashing(odd, "key", "size", "low", "kept"), length=400).collect()
    assert Counter((r["doc_id"], bytes(r["kept"])) for r in out) == Counter((i, (t or "").encode()) for i, t, *_ in ODD)
    two = spark.createDataFrame([(1, "é" * 600), (2, "x" + "é" * 500)], "doc_id long, text string")
    kept = prefix_free.without_repeats(two, length=401, whole_characters=True).collect()
    assert all(bytes(r["kept"]).decode() is not None for r in kept)
    assert prefix_free.without_repeats(empty).count() == 0


# 10


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abcdeT  'sé漢١²½_-!?\n\t\r\x1c\x85　\xa0Ⅷ😀", "<|endoftext|>", " don't", "'ll", "  \n"]), max_size=30).map("".join), max_size=5))
def test_codec_equals_the_library(library, texts):
    codec = bpe.codec_of(bpe.tokenizer_source(byte_bpe_path()))
    for t, run in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(run, "<u4")
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert codec.decode_text(ids) == library.decode(want, skip_special_tokens=False)


def test_round_trip_of_rows(spark, docs, rows, library, odd, empty):
    out = {r["doc_id"]: r for r in bpe.round_trip(docs.select("doc_id", "text"), byte_bpe_path()).collect()}
    for k, t in rows:
        ids = np.array(library.encode(t, add_special_tokens=False).ids, "<u4")
        assert (out[k]["n_tokens"], out[k]["ids_sha256"], out[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = bpe.decode_column(bpe.encode_column(clashing(odd, "ids"), byte_bpe_path()), byte_bpe_path()).collect()
    assert Counter(r["text"] for r in got) == Counter(t or "" for _, t, *_ in ODD)
    assert bpe.round_trip(clashing(empty, "n_tokens"), byte_bpe_path()).count() == 0


def test_shingle_hashes_in_parts_are_the_same():
    raw, offsets = byte_view(pa.array(["Ab cd  EF " * 50, "x", ""]))
    a, b, _ = shingles.words(raw, offsets)
    assert (shingles.word_hashes(raw, a, b) == shingles.word_hashes(raw, a, b, most=17)).all()


def test_deep_pages_and_names_of_several_words(spark):
    page = lambda i, more="": f"<html><body><article><h1>Title {i}</h1><p>Words of page {i} that stay where they are.</p>{more}</article></body></html>"
    slot = lambda i: f'<div class="promo-slot">Offer number {i}</div>'
    deep = "<article>" + "<div>" * 100_000 + "deep words" + "</div>" * 100_000 + "</article>"
    rows = [(i, f"http://a.example/{i}", page(i, slot(i))) for i in range(6)]
    rows += [(10, "http://b.example/1", page(10, '<div class="related-work"><p>Work like this.</p></div><section id="search-results"><p>Found things.</p></section>')), (11, "http://b.example/2", deep)]
    out = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"Title {i}\nWords of page {i} that stay where they are." for i in range(6))
    assert out[10].endswith("Work like this.\nFound things.") and out[11] == "deep words"


def test_tables_go_with_their_block(spark):
    from plumbline.llm import common

    with common.scratch(spark):
        inner = common.materialise(spark.range(3), "inner")
        outer = common.materialise(spark.range(4), "outer", outlives=True)
        paths = [f.inputFiles()[0].rsplit("/", 1)[0] for f in (inner, outer)]
    exists = [spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    assert exists == [False, True] and outer.count() == 4


@pytest.mark.parametrize("name", ["op3_lsh_forest", "op6_line_runs"])
def test_queries_match_sql(spark, sf_dir, name):
    import duckdb

    from plumbline.llm import queries

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_line_runs_sql_knows_blank_lines(spark, tmp_path):
    import duckdb

    from plumbline.llm import queries

    rnd = np.random.default_rng(11)
    pool = ["", "", " ", "\t", "one line", "two", "\u00a0", "three more", "x"]
    made = [(k, "\n".join(pool[i] for i in rnd.integers(0, len(pool), rnd.integers(1, 9)))) for k in range(120)] + [(200, None), (201, ""), (202, "\n\n")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(queries.ORACLE_SQL["op6_line_runs"])
    got = queries.op6_line_runs(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
    gone = lines_by_force([(k, t) for k, t in made if t is not None], 1)
    assert {r["doc_id"]: r["n_removed"] for r in got} == {k: sum(g[0] == k for g in gone) for k, _ in made}


def test_repeats_query_gives_the_text(spark, sf_dir):
    from plumbline.llm import queries

    out = queries.op9_prefix_free(spark, sf_dir).where("n_removed = 0").join(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text AS own"), "doc_id")
    assert out.count() > 0 and out.where("text <> own").count() == 0


def test_repeats_query_holds_to_400_bytes(spark, tmp_path):
    from plumbline.llm import queries

    rnd = np.random.default_rng(400)
    own = lambda n: " ".join("".join(rnd.choice(list("abcdeéß"), 6)) for _ in range(n))
    # Passages of over 50 words in two texts each; the bytes around them differ, so that each is shared at its size.
    sizes, texts = [360, 394, 398, 399, 400, 401, 420, 500], []
    for size in sizes:
        words = " ".join("".join(rnd.choice(list("fghij"), 6)) for _ in range(51))
        passage = f" {words} ".ljust(size, "k")
        texts += [f"{own(80)}{a}{passage}{b}{own(80)}" for a, b in ("AB", "CD")]
    texts += [own(150) for _ in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op9_prefix_free(spark, str(tmp_path)).collect()}
    want = repeats_by_force([t.encode() for t in texts], 400)
    assert [tuple(out[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == [(*x[:3], hashlib.sha256(x[3]).hexdigest()) for x in want]
    # n_bytes is the input's size, whether a passage goes or stays.
    assert [out[i]["n_removed"] for i in range(len(texts))] == [n * (n >= 400) for n in sizes for _ in range(2)] + [0] * 4
    assert all(out[i]["n_bytes"] == len(t.encode()) for i, t in enumerate(texts))


def test_written_tables_leave_no_shuffle_files(spark):
    import glob
    import time

    from plumbline.llm import common

    folder = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    files = lambda: set(glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))
    before, setting = files(), spark.conf.get(common._CLEANUP)
    with common.scratch(spark):
        out = common.materialise(spark.range(50_000).repartition(5, F.xxhash64("id")), "spread")
        for _ in range(40):  # files are removed in the background
            if files() <= before:
                break
            time.sleep(0.25)
        assert files() <= before and out.count() == 50_000
    assert spark.conf.get(common._CLEANUP) == setting
