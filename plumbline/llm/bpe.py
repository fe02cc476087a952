"""Byte-level BPE by prefix-sharing trie traversal, and its decoding.

Distinct words are visited in sorted order, which is a depth-first walk of their trie. Each trie node keeps the
last token of the encoding of its prefix, so an encoding shared by words is computed once. A token t ends the
encoding of a prefix p exactly if t is a suffix of p and the last token of p without t may stand before t, that
is, merging the bytes of both gives the two tokens back. That last token is unique, so the walk is exact.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, ragged

#: Fixed value: the byte-level pre-tokenizer's split pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside white space, or at an end: then words can't be cut at single spaces and line ends.
_LOOSE = re.compile(r"\s\s|^\s|\s$")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE tokenizer read from the JSON of the tokenizers library.

    remembered bounds the words and chunks that are kept between texts; it changes speed and memory, not results.
    """

    def __init__(self, source: bytes, remembered: int = 500_000) -> None:
        spec = json.loads(source)
        model, letters = spec["model"], _byte_letters()
        if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer")
        self.tokens = {bytes(letters[c] for c in k): v for k, v in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that strip or stand alone aren't supported")
        self._marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        written = dict(self.tokens)
        written |= {bytes(letters[c] for c in k): v for k, v in ((x["content"], x["id"]) for x in spec["added_tokens"]) if all(c in letters for c in k)}
        size = 1 + max(written.values())
        table = [b""] * size
        for k, v in written.items():
            table[v] = k
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.lengths = np.array([len(x) for x in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        # For each merge: its rank by the pair, and for each token the pair and rank that make it.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = (model["vocab"][x] for x in (left, right))
            self.rank[a, b] = r
            self.made.setdefault(model["vocab"][left + right], (a, b, r))
        self._fits: dict[tuple[int, int], bool] = {}
        # Tokens that merging never yields take no part: each must come back from its own bytes.
        self.usable = dict(self.tokens)
        for k, v in list(self.usable.items()):
            if len(k) > 1 and (v not in self.made or not self.fits(*self.made[v])):
                del self.usable[k]
        self.longest = max(map(len, self.usable))
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self._first: dict[str, bytes] = {}
        self._spaced: dict[str, bytes] = {}

    def fits(self, left: int, right: int, made: int | None = None) -> bool:
        """Whether merging the bytes of two tokens gives these two back; with made, whether it joins them by that merge.

        Merges are undone from the latest on; if at some moment the pieces that touch at the seam could have merged
        earlier than the merge that is undone next there, merging would have joined across the seam.
        """
        never = len(self.rank)
        upper = never if made is None else made
        a, b = left, right
        crossing = self.rank.get((a, b), never) if made is None else never
        while True:
            if crossing < upper:
                return False
            ma, mb = self.made.get(a), self.made.get(b)
            ra, rb = ma[2] if ma else -1, mb[2] if mb else -1
            if ra < 0 and rb < 0:
                return True
            # The later of the two merges is undone. A crossing merge of the left's rank comes after the left's (the
            # leftmost pair goes first), one of the right's rank comes before the right's.
            if ra > rb:
                upper, a = ra, ma[1]
            else:
                upper, b = rb + 1, mb[0]
            crossing = self.rank.get((a, b), never)

    def _walk(self, words: list[bytes]) -> list[bytes]:
        """Encodings of sorted distinct words, as little-endian unsigned 32-bit integers."""
        get, longest, fits, known = self.usable.get, self.longest, self.fits, self._fits
        packed = self.packed
        last: list[int] = []  # last token and its length at each depth of the current path
        size: list[int] = []
        before = b""
        out = []
        for w in words:
            n = len(w)
            most = min(n, len(before))
            same = most
            if w[:most] != before[:most]:
                low, high = 0, most - 1  # the common prefix by bisection
                while low < high:
                    mid = (low + high + 1) // 2
                    if w[:mid] == before[:mid]:
                        low = mid
                    else:
                        high = mid - 1
                same = low
            del last[same:], size[same:]
            for i in range(same + 1, n + 1):
                for k in range(i if i < longest else longest, 0, -1):
                    t = get(w[i - k : i])
                    if t is None:
                        continue
                    if k == i:
                        break
                    pair = (last[i - k - 1], t)
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = fits(*pair)
                    if ok:
                        break
                else:
                    raise ValueError("a prefix has no encoding")
                last.append(t)
                size.append(k)
            run, i = [], n
            while i:
                run.append(packed[last[i - 1]])
                i -= size[i - 1]
            run.reverse()
            out.append(b"".join(run))
            before = w
        return out

    def _index(self, first: set[str], spaced: set[str]) -> None:
        """Learns chunks: those that begin a text or line, and those after one space."""
        new = [(self._first, c, WORDS.findall(c)) for c in first if c not in self._first]
        new += [(self._spaced, c, WORDS.findall(" " + c)) for c in spaced if c not in self._spaced]
        words = {w for _, _, ws in new for w in ws}
        known = {w: k for w in words if (k := self._spaced.get(w[1:]) if w[0] == " " else self._first.get(w)) is not None}
        order = sorted((w.encode(), w) for w in words.difference(known))
        known.update(zip((w for _, w in order), self._walk([b for b, _ in order]), strict=True))
        for into, c, ws in new:
            into[c] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        plans: list[list[list[str]] | None] = []
        first: set[str] = {"\n"}
        spaced: set[str] = set()
        for text in texts:
            if not text or _LOOSE.search(text) or (self._marks and self._marks.search(text)):
                plans.append(None)
                continue
            lines = [line.split(" ") for line in text.split("\n")]
            for parts in lines:
                first.add(parts[0])
                spaced.update(parts)
            plans.append(lines)
        self._index(first, spaced)
        at_first, at_spaced, out = self._first, self._spaced, []
        for text, lines in zip(texts, plans, strict=True):
            if lines is None:
                out.append(self._marked(text))
                continue
            runs: list[bytes] = []
            for parts in lines:
                if runs:
                    runs.append(at_first["\n"])
                runs.append(at_first[parts[0]])
                if len(parts) > 1:
                    runs.extend(map(at_spaced.__getitem__, parts[1:]))
            out.append(b"".join(runs))
        if len(at_first) + len(at_spaced) > self.remembered:
            self._first = {k: at_first[k] for k in first if len(k) < 40}
            self._spaced = {k: at_spaced[k] for k in spaced if len(k) < 40}
        if len(self._fits) > self.remembered:
            self._fits.clear()
        return out

    def _words_of(self, text: str) -> bytes:
        words = WORDS.findall(text)
        order = sorted((w.encode(), w) for w in set(words))
        known = dict(zip((w for _, w in order), self._walk([b for b, _ in order]), strict=True))
        return b"".join([known[w] for w in words])

    def _marked(self, text: str) -> bytes:
        """A text that may hold special tokens or white space of any kind."""
        if not self._marks:
            return self._words_of(text)
        out, at = [], 0
        for m in self._marks.finditer(text):
            out += [self._words_of(text[at : m.start()]), self.packed[self.special[m[0]]]]
            at = m.end()
        return b"".join([*out, self._words_of(text[at:])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, those of special tokens included; unknown ids are left out."""
        known = ids[ids < len(self.lengths)].astype(np.int64)
        return self.bytes[ragged(self.starts[known], self.lengths[known])].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        return self.decode(ids).decode("utf-8", "replace")


_CODECS: dict[bytes, Codec] = {}


def codec_of(source: bytes) -> Codec:
    """The codec of a tokenizer file's bytes; a Python worker keeps the last one, with what it has learned."""
    key = hashlib.sha256(source).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(source)
    return _CODECS[key]


def tokenizer_source(path: str, most: int = 64 << 20) -> bytes:
    """The bytes of a tokenizer file on the driver, to be sent to the executors; its size is checked."""
    with open(path, "rb") as f:
        source = f.read(most + 1)
    if len(source) > most:
        raise ValueError(f"{path} has more than {most} bytes")
    return source


def encode_column(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Replaces a text column by its token ids (array of int; null text: as empty, which gives no ids). Other columns stay; one that had the name out is replaced."""
    df = df if out == text else df.drop(out)
    others = [f.name for f in df.schema if f.name != text]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    source = df.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for batch in batches:
            for part in blocks(batch, text):
                runs = codec.encode([x or "" for x in part.column(text).to_pylist()])
                ends = np.cumsum([0, *(len(r) // 4 for r in runs)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(runs), np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [lists], [*others, out])

    return df.select(*others, text).mapInArrow(run, schema)


def decode_column(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Replaces a column of token ids by their text (invalid UTF-8 as U+FFFD; null ids: null). Other columns stay; one that had the name out is replaced."""
    df = df if out == ids else df.drop(out)
    others = [f.name for f in df.schema if f.name != ids]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(out, T.StringType())])
    source = df.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for batch in batches:
            texts = [None if x is None else codec.decode_text(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(texts, pa.string())], [*others, out])

    return df.select(*others, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Replaces a text column by digests of its encoding and of what that decodes to, without moving ids between processes.

    Adds n_tokens, ids_sha256 and ids_crc32 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8).
    Null text: as empty. Rows are independent of each other, so ties, repeats and empty tables need no rule. Other columns
    stay; those that had the names of the new ones are replaced.
    """
    df = df.drop(*({"n_tokens", "ids_sha256", "ids_crc32", "decoded_sha256"} - {text}))
    others = [f.name for f in df.schema if f.name != text]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType())])
    source = df.sparkSession.sparkContext.broadcast(tokenizer_source(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(source.value)
        for batch in batches:
            for part in blocks(batch, text, 4 << 20):
                n, sums, crcs, decoded = [], [], [], []
                for raw in codec.encode([x or "" for x in part.column(text).to_pylist()]):
                    own = codec.decode(np.frombuffer(raw, "<u4"))
                    n.append(len(raw) // 4)
                    sums.append(hashlib.sha256(raw).hexdigest())
                    crcs.append(zlib.crc32(raw))
                    decoded.append(hashlib.sha256(own.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in others] + [pa.array(n, pa.int64()), pa.array(sums), pa.array(crcs, pa.int64()), pa.array(decoded)], [*others, "n_tokens", "ids_sha256", "ids_crc32", "decoded_sha256"])

    return df.select(*others, text).mapInArrow(run, schema)
