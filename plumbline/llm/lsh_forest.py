"""Near-duplicate documents by an LSH forest of min-wise signatures, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, byte_view, drop_table, materialise, materialise_at, partitions, scratch
from .components import components
from .shingles import set_ids, shingle_sets, signatures

_BLOCK = 2 << 20
#: Sketches have a bit for each of 512 labels, of which the first 128 give the orders.
_BITS = 512
_SKETCH = [f"s{i}" for i in range(1, _BITS // 64 + 1)]


def with_signatures(df: DataFrame, text: str, trees: int, depth: int, width: int) -> DataFrame:
    """Replaces a text column by n_shingles, node (a hash of the shingle set; null if empty), two longs of signature
    order for each tree (hi, lo) and a sketch of eight longs (one bit for each of 512 labels).
    """
    if depth != 8 or trees * depth != 128:
        raise ValueError("signatures have 128 labels, 8 for each of 16 trees")
    others = [f.name for f in df.schema if f.name != text]
    longs = T.ArrayType(T.LongType(), False)
    more = [("n_shingles", T.LongType()), ("node", T.LongType()), ("hi", longs), ("lo", longs), *((c, T.LongType()) for c in _SKETCH)]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(n, t) for n, t in more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text, _BLOCK):
                sets, at = shingle_sets(*byte_view(part.column(text)), width)
                sizes = np.diff(at)
                labels = signatures(sets, at, _BITS)
                # Big-endian halves, moved so that signed order is the order of the labels.
                order = np.ascontiguousarray(labels[:, : trees * depth]).astype(">u2").view(">u8").reshape(-1, trees, 2).astype(np.uint64) ^ np.uint64(1 << 63)
                order = order.view(np.int64)
                bits = np.packbits((labels & 1).astype(np.uint8), axis=1).view(np.int64).reshape(-1, len(_SKETCH))
                steps = pa.array(np.arange(len(sizes) + 1) * trees, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in others]
                    + [pa.array(sizes, pa.int64()), pa.array(set_ids(sets, at), pa.int64(), mask=sizes == 0)]
                    + [pa.ListArray.from_arrays(steps, pa.array(np.ascontiguousarray(order[:, :, k]).ravel(), pa.int64())) for k in (0, 1)]
                    + [pa.array(np.ascontiguousarray(bits[:, k]), pa.int64()) for k in range(len(_SKETCH))],
                    [*others, *(n for n, _ in more)],
                )

    return df.select(*others, text).mapInArrow(run, schema)


def _near(rows: dict[str, np.ndarray], window: int, least: int, most_bits: int, share: float, across: bool) -> pd.DataFrame:
    """Pairs of rows at most window apart in order that share a prefix of least labels of the same tree."""
    n = len(rows["tree"])
    cover = np.int64(-1) << np.int64(16 * (4 - least))
    found = []
    for w in range(1, min(window, n - 1) + 1):
        a, b = slice(0, n - w), slice(w, n)
        ok = (rows["tree"][a] == rows["tree"][b]) & (((rows["hi"][a] ^ rows["hi"][b]) & cover) == 0)
        if across:
            ok &= rows["part"][a] != rows["part"][b]
        i = np.flatnonzero(ok)
        j = i + w
        x, y = rows["n"][i], rows["n"][j]
        # Of unsigned numbers: of negative ones, bitwise_count takes the absolute value.
        bits = sum(np.bitwise_count((rows[s][i] ^ rows[s][j]).view(np.uint64)).astype(np.int64) for s in _SKETCH)
        keep = (bits <= most_bits) & (np.minimum(x, y) >= share * np.maximum(x, y)) & (rows["root"][i] != rows["root"][j])
        i, j, bits = i[keep], j[keep], bits[keep]
        p, q = rows["node"][i], rows["node"][j]
        found.append(pd.DataFrame({"a": np.minimum(p, q), "b": np.maximum(p, q), "bits": bits}))
    return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "bits": []}, dtype="int64")


def candidates(nodes: DataFrame, *, window: int, least: int, most_bits: int, share: float) -> DataFrame:
    """Pairs a < b of nodes with different roots that are neighbours in some signature order, with the number of sketch bits that differ.

    Each tree sorts all nodes by its labels and, where these are equal, by the next tree's, over range partitions. A node meets the window rows after it, as far as
    they share least labels with it. Sorting puts the longest common prefixes next to it, so the depth that a meeting
    needs adapts: in sparse regions all that share least labels meet, in dense ones those that share the most.
    """
    spark = nodes.sparkSession
    turned = [F.concat(F.slice(c, 2, F.size(c)), F.slice(c, 1, 1)).alias(f"next_{c}") for c in ("hi", "lo")]
    orders = F.arrays_zip("hi", "lo", *turned)
    rows = nodes.select("node", "root", F.col("n_shingles").alias("n"), *_SKETCH, F.posexplode(orders).alias("tree", "o"))
    rows = rows.select("tree", *[F.col(f"o.{c}").alias(c) for c in ("hi", "lo", "next_hi", "next_lo")], "node", "root", "n", *_SKETCH)
    keys = ["tree", "hi", "lo", "next_hi", "next_lo", "node"]
    placed = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    names = [*keys, "root", "n", *_SKETCH]
    schema = "a long, b long, bits long, part int, at long, " + ", ".join(f"{c} {'int' if c == 'tree' else 'long'}" for c in names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done, tail = TaskContext.get().partitionId(), 0, None
        head: list[pd.DataFrame] = []
        for frame in frames:
            both = frame if tail is None else pd.concat([tail, frame], ignore_index=True)
            pairs = _near({c: both[c].to_numpy() for c in names}, window, least, most_bits, share, False)
            if len(pairs):
                yield pairs.drop_duplicates(["a", "b"]).reindex(columns=[x.split()[0] for x in schema.split(", ")])
            if done < window:
                head.append(frame.iloc[: window - done].assign(part=part, at=np.arange(done, min(window, done + len(frame)))))
            done += len(frame)
            tail = both.iloc[-window:]
        edge = list(head)
        if tail is not None:
            last = tail.assign(part=part, at=np.arange(done - len(tail), done))
            edge.append(last[last["at"] >= window])
        for e in edge:
            yield e.reindex(columns=[x.split()[0] for x in schema.split(", ")])

    found = materialise(placed.mapInPandas(run, schema), "forest")
    inside = found.where("a is not null").select("a", "b", "bits")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_ = [f for f in frames if len(f)]
        if all_:
            edge = pd.concat(all_).sort_values(["part", "at"])
            yield _near({c: edge[c].to_numpy() for c in [*names, "part"]}, window, least, most_bits, share, True)

    # The first and last window rows of each partition, 2 * window * partitions in all, meet in one task.
    edges = found.where("a is null").select("part", "at", *names).coalesce(1).mapInPandas(meet, "a long, b long, bits long")
    return inside.unionAll(edges).groupBy("a", "b").agg(F.min("bits").alias("bits"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in blocks(batch, "ta", _BLOCK):
                for part in blocks(half, "tb", _BLOCK):
                    (x, xa), (y, ya) = (shingle_sets(*byte_view(part.column(c)), width) for c in ("ta", "tb"))
                    keep = []
                    for i in range(part.num_rows):
                        p, q = x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]
                        both = np.concatenate([p, q])
                        both.sort()
                        common = int((both[1:] == both[:-1]).sum())
                        keep.append(100 * common >= percent * (len(p) + len(q) - common))
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    width: int = 5,
    percent: int = 80,
    trees: int = 16,
    depth: int = 8,
    least: int = 3,
    window: int = 32,
    first_window: int = 4,
    rounds: int = 3,
    hubs: int = 8,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    Documents with equal sets count as one node before any pair is made. Candidates come from the forest; those that
    differ in more of 512 sketch bits than a linked pair does (by over 3.7 standard deviations) are left out, the others are
    confirmed on their full sets: first, in a few rounds, the likeliest partner of each node in another component among the
    first_window next ones, then every candidate of the whole window whose ends are still in different components. In a group of many variants, most are linked to few texts only, such as the common
    original. So a node that still has candidates in another component meets that component's hubs, its best linked
    texts, too.

    Returns key, n_shingles, component_id (the smallest key in the component) and kept (key = component_id).
    Null or empty texts and texts without words have no shingles and stand alone. Null keys: the document takes part;
    its component_id is the component's smallest key, null if there is none, and kept is false. Repeated rows are kept
    and share their component. An empty table gives no rows. Other columns of df are not read.
    """
    with scratch(df.sparkSession):
        return _grouped(df, text, key, width, percent, trees, depth, least, window, first_window, rounds, hubs)


def _with_hubs(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots with each component's hub, the node with most links, and their number."""
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    hub = ends.join(roots, "node").groupBy("root").agg(F.max(F.struct("degree", "node")).alias("hub"))
    return roots.join(hub, "root")


def _hubs_of(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) between two components, with ha and hb, the hubs of their ends' components (null: not linked)."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("hub").alias(f"h{c}")), c, "left")
    return pairs


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).drop("ra", "rb")


def _texts_of(pairs: DataFrame, nodes: DataFrame, base: DataFrame) -> tuple[DataFrame, str]:
    """(node, text) for the nodes of pairs, one text of each, as a table; and its path."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(nodes.select("node", "one.tkey", F.col("one.k").alias("k")), "node")
    found = base.select(F.coalesce("key", F.lit((1 << 63) - 1)).alias("k"), "tkey", "text").join(wanted, ["k", "tkey"])
    return materialise_at(found.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _hub_pairs(apart: DataFrame, hubs: int) -> DataFrame:
    """(a, b): each node that has candidates in other components, with up to hubs of these components' hubs.

    Hubs fall into parts by hash, and of each part the one with most links counts: a maximum, found before any shuffle.
    """
    sides = [apart.select(F.col(x).alias("node"), F.col(f"h{y}").alias("hub")) for x, y in ("ab", "ba")]
    part = F.pmod(F.xxhash64("hub.node"), F.lit(hubs)).alias("part")
    meets = sides[0].unionAll(sides[1]).where("hub IS NOT NULL").groupBy("node", part).agg(F.max("hub").alias("hub"))
    return meets.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _grouped(df: DataFrame, text: str, key: str, width: int, percent: int, trees: int, depth: int, least: int, window: int, first_window: int, rounds: int, hubs: int) -> DataFrame:
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tkey"))
    signed = materialise(with_signatures(base, "text", trees, depth, width), "signatures")
    first = F.min(F.struct(F.coalesce("key", F.lit((1 << 63) - 1)).alias("k"), "tkey"))
    nodes = signed.where("node is not null").groupBy("node").agg(
        F.min("key").alias("least_key"), first.alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("hi").alias("hi"), F.first("lo").alias("lo"), *[F.first(c).alias(c) for c in _SKETCH]
    )
    nodes = materialise(nodes, "nodes")
    bits, agree = _BITS, 0.5 + percent / 200
    most = int(np.ceil(bits * (1 - agree) + 3.7 * np.sqrt(bits * agree * (1 - agree))))
    found = {"least": least, "most_bits": most, "share": percent / 100}

    pairs = materialise(candidates(nodes.withColumn("root", F.col("node")), window=min(first_window, window), **found), "candidates")
    texts, path = _texts_of(pairs, nodes, base)
    links, done, still = None, None, pairs
    for _ in range(rounds):
        # Each node with its likeliest partner of those in another component: as many pairs as nodes at most.
        sides = [still.select(F.col(x).alias("node"), F.col(y).alias("other"), "bits") for x, y in ("ab", "ba")]
        best = sides[0].unionAll(sides[1]).groupBy("node").agg(F.min(F.struct("bits", "other")).alias("m"))
        best = materialise(best.select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct(), "asked")
        if best.isEmpty():
            break
        new = materialise(confirmed(best, texts, width, percent), "links")
        links, done = (new, best) if links is None else (links.unionAll(new), done.unionAll(best))
        roots = materialise(components(links), "roots")
        still = _apart(pairs, roots).join(done, ["a", "b"], "left_anti")
    drop_table(df.sparkSession, path)
    if links is None:
        links = done = pairs.select("a", "b")
        roots = materialise(components(links), "roots")
    # Neighbours in the whole window count where they still lie in two components; they are looked at one by one, and so
    # are they with the other component's hubs.
    known = materialise(_with_hubs(roots, links), "roots")
    rooted = nodes.join(known.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = materialise(_hubs_of(candidates(rooted, window=window, **found), known), "apart")
    asked = materialise(apart.select("a", "b").unionAll(_hub_pairs(apart, hubs)).distinct().join(done, ["a", "b"], "left_anti"), "asked")
    texts, _ = _texts_of(asked, nodes, base)
    links = links.unionAll(materialise(confirmed(asked, texts, width, percent), "links"))
    roots = materialise(components(links), "roots")

    own = nodes.select("node", "least_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_of = own.groupBy("root").agg(F.min("least_key").alias("component_id"))
    label = own.join(least_of, "root").select("node", "component_id")
    out = signed.select("key", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id"))
    out = out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
    return materialise(out, "groups", outlives=True)
