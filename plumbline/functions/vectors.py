"""Vector expressions in the JVM, and the rows nearest to many probes by blocks of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: float | None = None) -> Column:
    """Cosine similarity; where a norm is zero, ``zero`` (default null)."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(zero).cast("double")).otherwise(dot(a, b) / n)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


# Rows and probes of one product, what its similarities may be off by (and what rounding to nine places joins), and
# sizes beyond which a vector is compared number by number.
_ROWS, _PROBES, _MARGIN, _LEAST, _MOST = 8192, 256, 1e-8, 1e-100, 1e100


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows of a matrix, their norms, and which have the usual length and usual numbers; the others' rows are zero."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    dim = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 1
    if a.null_count == 0 and (lengths == dim).all() and a.flatten().null_count == 0:
        out, usual = a.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(a), dim), np.ones(len(a), bool)
    else:
        lists = a.to_pylist()
        usual = np.array([x is not None and len(x) == dim and None not in x for x in lists], bool)
        out = np.array([x if u else [0.0] * dim for x, u in zip(lists, usual, strict=True)], "float64").reshape(len(a), dim)
    with np.errstate(all="ignore"):
        usual &= np.isfinite(out).all(axis=1) & (np.abs(out).max(axis=1, initial=0) < _MOST)
        out[~usual] = 0.0
        total = np.zeros(len(out))
        for j in range(dim):
            total += out[:, j] * out[:, j]
        norms = np.sqrt(total)
        usual &= (norms == 0) & (out == 0).all(axis=1) | (norms > _LEAST)
    return out, norms, usual


def _one(x: list | None, y: list | None) -> float | None:
    """cosine(x, y, 0.0) as the JVM has it: in order, null where a number is missing."""
    if x is None or y is None or None in x or None in y:
        return None
    with np.errstate(all="ignore"):
        dots = [np.float64(0.0)] * 3
        for i, (a, b) in enumerate(((x, y), (x, x), (y, y))):
            for p, q in zip(a, b, strict=False):
                dots[i] = dots[i] + np.float64(p) * np.float64(q)
        n = np.sqrt(dots[1]) * np.sqrt(dots[2])
        return 0.0 if n == 0 else None if len(x) != len(y) else float(dots[0] / n)


def _nearest(rows: pa.Table, probes: pa.Table, k: int, own: str | None, floor: float | None) -> Iterator[pa.Table]:
    """Of rows (id, _e) those that may be among the k nearest of each probe (keys, probe), with exact similarities."""
    keys = probes.drop_columns(["probe"])
    p, p_norms, p_usual = _matrix(probes["probe"])
    asked = np.arange(len(p)) if own is None else np.flatnonzero(~pc.is_null(probes[own]).to_numpy(zero_copy_only=False))
    own_ids = probes[own].to_pylist() if own else None
    for at in range(0, len(rows), _ROWS):
        part = rows.slice(at, _ROWS)
        ids = part["id"].combine_chunks()
        v, norms, usual = _matrix(part["_e"])
        if len(asked) and v.shape[1] != p.shape[1]:
            usual = np.zeros(len(v), bool)
        place = np.empty(len(v), "int64")
        place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(v))
        known = ~pc.is_null(ids).to_numpy(zero_copy_only=False)
        place[~known] = -1
        where = {}
        if own:
            for i, x in enumerate(ids.to_pylist()):
                where.setdefault(x, []).append(i)
        rest = np.flatnonzero(known & usual if own else usual)
        odd = np.flatnonzero(known & ~usual if own else ~usual)
        lists = None
        for b in range(0, len(asked), _PROBES):
            some = asked[b : b + _PROBES]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            fine = some[p_usual[some]]
            if len(fine) and len(rest):
                n = norms[rest, None] * p_norms[None, fine]
                with np.errstate(all="ignore"):
                    near = np.where(n == 0, 0.0, (v[rest] @ p[fine].T) / n)
                if own:
                    spot = {r: i for i, r in enumerate(rest)}
                    for j, q in enumerate(fine):
                        near[[spot[r] for r in where.get(own_ids[q], ()) if r in spot], j] = -np.inf
                least = np.partition(near, len(rest) - k, axis=0)[len(rest) - k] if len(rest) > k else np.full(len(fine), -2.0)
                least = np.maximum(least, -2.0 if floor is None else floor) - _MARGIN
                r, j = np.nonzero(near >= least)
                r, q = rest[r], fine[j]
                total = np.zeros(len(r))
                for d in range(v.shape[1]):
                    total += v[r, d] * p[q, d]
                n = norms[r] * p_norms[q]
                with np.errstate(all="ignore"):
                    found.append((q, r, np.where(n == 0, 0.0, total / n), np.zeros(len(r), bool)))
            pairs = [(q, r) for q in some for r in (odd if p_usual[q] else np.concatenate([rest, odd])) if not own or r not in where.get(own_ids[q], ())]
            if pairs:
                if lists is None:
                    lists, wanted = part["_e"].to_pylist(), probes["probe"].to_pylist()
                got = [_one(lists[r], wanted[q]) for q, r in pairs]
                q, r = np.array(pairs, "int64").T
                found.append((q, r, np.array([np.nan if x is None else x for x in got]), np.array([x is None for x in got])))
            if not found:
                continue
            q, r, s, none = (np.concatenate(x) for x in zip(*found, strict=True))
            if floor is not None:
                held = ~none & ((s > floor) | np.isnan(s))
                q, r, s, none = q[held], r[held], s[held], none[held]
            # Of equal similarities only the k smallest ids can count.
            order = np.lexsort((place[r], s, none, q))
            q, r, s, none = q[order], r[order], s[order], none[order]
            same = (q[1:] == q[:-1]) & (none[1:] == none[:-1]) & ((s[1:] == s[:-1]) | np.isnan(s[1:]) & np.isnan(s[:-1]))
            first = np.concatenate([[0], np.where(same, 0, np.arange(1, len(q)))]) if len(q) else np.zeros(0, "int64")
            held = np.arange(len(q)) - np.maximum.accumulate(first) < k if len(q) else np.zeros(0, bool)
            q, r, s, none = q[held], r[held], s[held], none[held]
            yield keys.take(pa.array(q)).append_column("id", ids.take(pa.array(r))).append_column("similarity", pa.array(s, "float64", mask=none))


def nearest(rows: DataFrame, probes: DataFrame, k: int, *, own: str | None = None, floor: float | None = None, most: int = 4096) -> DataFrame:
    """(keys, id, similarity): of all pairs of rows (id, _e) and probes (keys, probe) those that may be among a probe's k nearest, by
    cosine(_e, probe, 0.0), bit for bit as the JVM has it; ranks are the caller's, by similarity, also rounded to nine places, then id.

    With own, the key that is a row's id, a probe doesn't meet its own row; with floor only similarities above it count. Blocks of
    rows meet blocks of probes as products of matrices; what may be among the k best of its block is compared number by number.
    Up to ``most`` probes (counted first) are broadcast. More form a grid of blocks of both, each pair of blocks a group of its own.
    """
    keys = [c for c in probes.columns if c != "probe"]
    kind = {f.name: f.dataType.simpleString() for f in (*probes.schema.fields, *rows.schema.fields)}
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*keys, "id"]) + ", similarity double"
    rows = rows.select("id", "_e")
    if probes.limit(most + 1).count() <= most:
        held = rows.sparkSession.sparkContext.broadcast(probes.select(*keys, "probe").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in _nearest(pa.Table.from_batches([batch]), held.value, k, own, floor):
                    yield from t.to_batches()

        return rows.mapInArrow(run, schema)
    across, down = (max(1, -(-df.count() // n)) for df, n in ((probes, most), (rows, 4 * _ROWS)))
    left = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(down)).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_c"))
    right = probes.select(*keys, "probe", F.pmod(F.xxhash64(*keys), F.lit(across)).cast("int").alias("_c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("_r"))

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            found = []
        else:
            found = list(_nearest(a.select(["id", "_e"]), b.select([*keys, "probe"]), k, own, floor))
        return pa.concat_tables(found) if found else b.select(keys).slice(0, 0).append_column("id", a["id"].slice(0, 0)).append_column("similarity", pa.array([], "float64"))

    return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(met, schema)
