"""Spelling variants: words one edit apart, by two-dimensional range reporting over forward and reverse order in wavelet trees."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_view, materialise, scratch
from .shingles import word_hashes, words

_BLOCK = 8 << 20
#: Letters by byte: A-Z, a-z, and the lead byte of U+00C0 to U+00FF, whose second bytes are found by their place.
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SHIFTS: dict[int, np.ndarray] = {}


def _crc_shift(n: int) -> np.ndarray:
    """Four tables of 256: what a CRC-32 becomes when n bytes follow it, by its bytes; the crc of a joined text is that
    of its first part, shifted, xor that of its second part."""
    if n not in _SHIFTS:
        zero = zlib.crc32(bytes(n))
        one = np.array([zlib.crc32(bytes(n), 1 << b) ^ zero for b in range(32)], np.uint32)
        byte = np.arange(256)
        table = np.zeros((4, 256), np.uint32)
        for b in range(8):
            table[:, (byte >> b & 1) > 0] ^= one.reshape(4, 8)[:, b, None]
        _SHIFTS[n] = table
    return _SHIFTS[n]


def _crc_joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of joined texts from those of their parts and the second parts' lengths."""
    out = second.copy()
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        t, f = _crc_shift(n), first[at]
        out[at] ^= t[0][f & 255] ^ t[1][f >> 8 & 255] ^ t[2][f >> 16 & 255] ^ t[3][f >> 24]
    return out


def runs_of_letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the maximal runs [A-Za-z\\u00C0-\\u00FF]+, and n + 1 offsets of texts into them."""
    lead = raw == 0xC3
    letter = _ASCII[raw] | lead
    letter[1:] |= lead[:-1]
    solid = letter.copy()
    if not len(raw):
        return words(raw, offsets)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(raw)]
    begin[inner] = solid[inner]
    end = solid.copy()
    end[:-1] &= ~solid[1:]
    edge = inner[inner > 0] - 1
    end[edge] = solid[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_counts(df: DataFrame, *, text: str = "text", key: str = "doc_id", every: int = 97, least: int = 5) -> DataFrame:
    """(word, n): runs of letters with A-Z as a-z, of at least least code points, and how often they occur in all texts.

    Where every divides the CRC-32 h of "<key>:<run>", the run's code point h % length is deleted first. Blocks of texts
    count their distinct words, so a frequent word is one row for each block. Null texts and empty ones have no words, a
    null key is an empty text before the colon, repeated rows count each. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", _BLOCK):
                raw, offsets = byte_view(part.column("text"))
                starts, ends, at = runs_of_letters(raw, offsets)
                if not len(starts):
                    continue
                _, first, place = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
                data = raw.tobytes().translate(_LOWER)
                found = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                crc = np.array([zlib.crc32(w) for w in found], np.uint32)
                doc = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in part.column("key").to_pylist()], np.uint32)
                h = _crc_joined(np.repeat(doc, np.diff(at)), crc[place], ends - starts)
                cut = h % np.uint32(every) == 0
                n = np.bincount(place[~cut], minlength=len(found))
                texts = [w.decode() for w in found]
                out = [(w, c) for w, c in zip(texts, n.tolist(), strict=True) if c and len(w) >= least]
                changed: dict[str, int] = {}
                for i, x in zip(place[cut].tolist(), h[cut].tolist(), strict=True):
                    w = texts[i]
                    if len(w) > least:
                        drop = x % len(w)
                        w = w[:drop] + w[drop + 1 :]
                        changed[w] = changed.get(w, 0) + 1
                out += changed.items()
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], ["word", "n"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletTree:
    """A permutation's values by level of their bits, high ones first: each level holds how many zeros stand before each place."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        now = values
        for b in range(self.bits - 1, -1, -1):
            low = (now >> b & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(low)]))
            now = np.concatenate([now[low], now[~low]])

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all places in [x1, x2) with values in [y1, y2), for many rectangles at once.

        All queries go down the tree together; a branch ends where its places or its values run out.
        """
        query, node = np.arange(len(x1)), np.zeros(len(x1), np.int64)
        a, b = x1.astype(np.int64), x2.astype(np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            a0, b0 = zeros[a], zeros[b]
            query, node = np.concatenate([query, query]), np.concatenate([node, node + width])
            a, b = np.concatenate([a0, zeros[-1] + a - a0]), np.concatenate([b0, zeros[-1] + b - b0])
            keep = (a < b) & (node < y2[query]) & (node + width > y1[query])
            query, node, a, b = query[keep], node[keep], a[keep], b[keep]
        return query, node


def _letters(texts: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").reshape(len(texts), length)


class _Order:
    """Rows sorted by group and letters; of each row and depth, the interval of members that share as many letters."""

    def __init__(self, group: np.ndarray, letters: np.ndarray, member: np.ndarray) -> None:
        n = len(group)
        key = np.ascontiguousarray(np.concatenate([group.astype(">u4").view(np.uint8).reshape(n, 4), letters.astype(">u2").view(np.uint8).reshape(n, -1)], axis=1))
        self.order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
        g, rows = group[self.order], letters[self.order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])
        self.common = np.concatenate([[-1], np.where(g[1:] == g[:-1], common, -1)])
        self.upto = np.concatenate([[0], np.cumsum(member[self.order])])
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)

    def interval(self, depth: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, new = len(self.common), self.common < depth
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, 0))
        last = np.append(np.flatnonzero(new), n)
        stop = last[np.searchsorted(last, at, side="right")]
        place = self.place[rows]
        return self.upto[start[place]], self.upto[stop[place]]


def near_pairs(texts: list[str], shorter: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (a, b) one edit apart within a group, each once for each direction.

    Members have length letters; shorter rows have one fewer and ask for members with one letter more. A row's edit lies
    at a position from low to high - 1. For each position, the members with the row's letters before it are an interval in
    forward order, those with its letters after it one in reverse order; a wavelet tree over the reverse places in
    forward order reports the members in both. A member's own rectangle holds itself, so rectangles of one column are skipped.
    """
    member = ~shorter
    own = np.zeros((len(texts), length), np.uint16)
    for which, size in ((member, length), (shorter, length - 1)):
        at = np.flatnonzero(which)
        if len(at) and size:
            own[at, :size] = _dense(_letters([texts[i] for i in at.tolist()], size))
    back = np.zeros_like(own)
    back[member] = own[member][:, ::-1]
    back[shorter, : length - 1] = own[shorter][:, : length - 1][:, ::-1]
    forward, reverse = _Order(group, own, member), _Order(group, back, member)
    by_forward = forward.order[member[forward.order]]
    by_reverse = reverse.order[member[reverse.order]]
    tree = WaveletTree(reverse.upto[reverse.place[by_forward]])
    found = [np.zeros((0, 2), np.int64)]
    for j in range(int(low.min()), int(high.max())):
        rows = np.flatnonzero((low <= j) & (j < high))
        if not len(rows):
            continue
        x1, x2 = forward.interval(j, rows)
        y1, y2 = reverse.interval(length - 1 - j, rows)
        least = np.where(shorter[rows], 0, 1)
        ask = (x2 - x1 > least) & (y2 - y1 > least)
        rows, x1, x2, y1, y2 = (x[ask] for x in (rows, x1, x2, y1, y2))
        query, value = tree.report(x1, x2, y1, y2)
        a, b = rows[query], by_reverse[value]
        both = np.stack([a, b], axis=1)[a != b]
        found += [both, both[shorter[both[:, 0]]][:, ::-1]]
    return tuple(np.unique(np.concatenate(found), axis=0).T)


def _dense(letters: np.ndarray) -> np.ndarray:
    """Letters as 16-bit numbers above 0; Latin letters have code points far below the bound."""
    if len(letters) and int(letters.max()) > 0xFFFE:
        raise ValueError("letters beyond U+FFFE")
    return letters.astype(np.uint16) + np.uint16(1)


def near_words(counts: DataFrame, *, most: int = 20_000, part_letters: int = 4_000_000) -> DataFrame:
    """(word, n, near, m): all pairs of distinct words of counts (word, n) that differ by one inserted, deleted or replaced
    code point, in both directions.

    An edit leaves the letters on one side of a position alone, so words meet under the letters outside a range of
    positions: first the halves of the longer length. A group above most rows is split by halving its range, which adds the
    letters of the other quarter to what must agree; at one position all letters but one agree and the alphabet bounds it.
    Groups are dealt to tasks by hash; a task holds one length and at most about part_letters letters, or one group.
    Null words are ignored; no words give no rows.
    """
    size = F.char_length("word")
    base = counts.where("word IS NOT NULL").select("word", "n", F.explode(F.array(F.struct(size.alias("length"), F.lit(False).alias("shorter")), F.struct((size + 1).alias("length"), F.lit(True).alias("shorter")))).alias("x")).select("word", "n", "x.*")

    def halves(df: DataFrame, low: str, high: str) -> DataFrame:
        mid = F.floor((F.col(low) + F.col(high)) / 2).cast("int")
        two = F.array(F.struct(F.col(low).alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col(high).alias("high")))
        cut = df.select("word", "n", "length", "shorter", F.explode(two).alias("r")).select("word", "n", "length", "shorter", "r.*").where("high > low")
        tail = F.col("length") - F.col("high")  # letters after the range, alike for members and shorter words
        outside = F.xxhash64("length", "low", "high", F.expr("substring(word, 1, low)"), F.when(tail > 0, F.right("word", tail)).otherwise(""))
        return cut.withColumn("meet", outside)

    def sized(df: DataFrame) -> DataFrame:
        return materialise(df.join(df.groupBy("meet").agg(F.count("*").alias("size")), "meet"), "ranges")

    rows = sized(halves(base.withColumn("from", F.lit(0)).withColumn("to", F.col("length")), "from", "to"))
    done = []
    while True:
        large = (F.col("size") > most) & (F.col("high") - F.col("low") > 1)
        done.append(rows.where(~large))
        rest = rows.where(large)
        if rest.isEmpty():
            break
        rows = sized(halves(rest.select("word", "n", "length", "shorter", F.col("low").alias("from"), F.col("high").alias("to")), "from", "to"))
    every = done[0]
    for df in done[1:]:
        every = every.unionByName(df)
    # A group without members, without a partner or without shorter words and a second member has no pair.
    every = every.where("size > 1")
    letters = every.agg(F.sum("length")).first()[0] or 0
    parts = max(1, letters // part_letters)

    def report(table: pa.Table) -> pa.Table:
        length = table.column("length")[0].as_py()
        group = np.unique(table.column("meet").to_numpy(), return_inverse=True)[1]
        low, high, shorter = (table.column(c).to_numpy() for c in ("low", "high", "shorter"))
        a, b = near_pairs(table.column("word").to_pylist(), shorter.astype(bool), group, low, high, length)
        left, right = table.take(pa.array(a)), table.take(pa.array(b))
        return pa.table({"word": left.column("word").cast(pa.string()), "n": left.column("n"), "near": right.column("word").cast(pa.string()), "m": right.column("n")})

    dealt = every.drop("size").withColumn("part", F.pmod(F.xxhash64("meet"), F.lit(parts)))
    return dealt.groupBy("length", "part").applyInArrow(report, "word string, n long, near string, m long").distinct()


def variants(df: DataFrame, *, text: str = "text", key: str = "doc_id", every: int = 97, least: int = 5, least_n: int = 3) -> DataFrame:
    """Words of all texts that occur least_n times or more, with their spelling's form: word, form, root, n, n_near, form_n.

    A word's form is its near word (one edit apart) of largest n, ties to the smallest in code-point order, if that n is
    at least twice the word's; else null. root is where forms lead from the word: n doubles with each step, so that
    chains have at most 63 steps, and pointers that double find their ends in six rounds. n_near counts near words. See
    word_counts() for words, null texts and keys; texts without such words add nothing, an empty table gives no rows.
    """
    with scratch(df.sparkSession):
        return _variants(df, text, key, every, least, least_n)


def _variants(df: DataFrame, text: str, key: str, every: int, least: int, least_n: int) -> DataFrame:
    counts = materialise(word_counts(df, text=text, key=key, every=every, least=least).where(F.col("n") >= least_n), "words")
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = near_words(counts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    own = counts.join(near, "word", "left")
    clear = F.col("best.m") * -1 >= F.col("n") * 2
    own = own.select("word", F.when(clear, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(clear, -F.col("best.m")).alias("form_n"))
    own = materialise(own, "forms")
    jump = own.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(jump.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jump = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    out = own.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return materialise(out, "variants", outlives=True)
