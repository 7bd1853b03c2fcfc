"""Byte-level BPE by a rank queue over linked lists.

All pre-tokens of a batch that aren't known yet stand in one linked list of byte tokens, with ends
between them. A bucket for each merge rank holds list positions; a hierarchical bitmap over the ranks
has a bit for each bucket that isn't empty, and find-first-set gives the lowest one. All entries of
that bucket that still hold are merged at once, which is what one after another would give: a merge
can only make pairs of higher rank (where a vocabulary allows a lower one, the bucket is taken one
entry a pre-token at a time). Stale entries are skipped. A pre-token of a million bytes costs no more
for each byte than a short one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from braidlake.llm.common import fresh, schema_of, table
from braidlake.llm.words import powers_of, blocks, mix64, text_bytes

#: Pre-tokens that a worker keeps with their ids; beyond it, it starts anew.
KEEP = 600_000
_NONE = np.int32(2**31 - 1)


class Bitmap:
    """Numbers from 0 to n-1 in levels of 64-bit words: a bit above stands for a word below that isn't 0."""

    def __init__(self, n: int):
        self.levels = []
        while True:
            n = (n + 63) // 64
            self.levels.append([0] * n)
            if n <= 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            x, bit = divmod(x, 64)
            before = level[x]
            level[x] = before | 1 << bit
            if before:
                return

    def remove(self, x: int) -> None:
        for level in self.levels:
            x, bit = divmod(x, 64)
            level[x] &= ~(1 << bit)
            if level[x]:
                return

    def first(self) -> int:
        """The least number, -1 if there is none."""
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            if not word:
                return -1
            x = x * 64 + (word & -word).bit_length() - 1
        return x


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file; every single byte is one of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[b[:i]] * self.size + ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
        self.merged = np.array([r for _, r in pairs] + [int(_NONE)], np.int64)
        self.orderly = np.full(self.size, _NONE, np.int64)  # the lowest rank of any pair that a token is part of
        np.minimum.at(self.orderly, self.keys[:-1] // self.size, self.merged[:-1])
        np.minimum.at(self.orderly, self.keys[:-1] % self.size, self.merged[:-1])
        self.orderly = (self.orderly > np.arange(self.size)).tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        ids, sizes = self.encode_flat(pieces)
        tokens, cuts = ids.tolist(), np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return [tokens[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all byte strings, how many each has): merged by lowest rank first, leftmost of equal ones."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return np.zeros(0, np.int32), lengths
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        after = np.arange(1, n + 1)  # the next token's position, n: none
        before = np.arange(-1, n - 1)
        nonempty = lengths > 0
        after[ends[nonempty] - 1] = n
        before[(ends - lengths)[nonempty]] = -1
        alive = np.ones(n + 1, bool)
        alive[n] = False
        pair = np.full(n + 1, _NONE, np.int64)  # rank of the pair that starts here
        there = np.flatnonzero(after < n)
        pair[there] = self.rank(ids[there], ids[after[there]])
        there = there[pair[there] != _NONE]
        buckets: dict[int, list[int]] = {}
        waiting = Bitmap(self.size)
        if len(there):
            by = there[np.argsort(pair[there], kind="stable")]
            cut = np.flatnonzero(np.diff(pair[by])) + 1
            for part in np.split(by, cut):
                r = int(pair[part[0]])
                buckets[r] = part.tolist()
                waiting.add(r)
        while (r := waiting.first()) >= 0:
            at = np.array(buckets.pop(r), np.int64)
            waiting.remove(r)
            at = at[alive[at] & (pair[at] == r)]
            if len(at) > 1:
                at = np.unique(at)
                if self.orderly[r]:
                    touch = after[at[:-1]] == at[1:]
                    if touch.any():  # of a run of overlapping pairs, every other one from its start
                        run = np.concatenate([[True], ~touch])
                        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                        at = at[(np.arange(len(at)) - start) % 2 == 0]
                else:
                    leftmost = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
                    if not leftmost.all():
                        buckets[r] = at[~leftmost].tolist()
                        waiting.add(r)
                        at = at[leftmost]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = r
            alive[gone] = False
            nxt = after[gone]
            after[at] = nxt
            inner = nxt < n
            before[nxt[inner]] = at[inner]
            pair[gone] = _NONE
            pair[at] = _NONE
            left = before[at]
            left = left[left >= 0]
            new = np.concatenate([at[inner], left])
            if not len(new):
                continue
            pair[new] = ranks = self.rank(ids[new], ids[after[new]])
            for p, k in zip(new.tolist(), ranks.tolist(), strict=True):
                if k != _NONE:
                    if k in buckets:
                        buckets[k].append(p)
                    else:
                        buckets[k] = [p]
                        waiting.add(k)
        alive = alive[:n]
        return ids[alive].astype(np.int32), np.bincount(owner[alive], minlength=len(pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


#: The one pattern that is split without a regular-expression engine.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


def cuts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of BYTE_LEVEL start in code points; first: marks the starts of texts.

    A run of one class starts a match, with the single U+0020 before it if there is one. Of a run of
    white space before something else, the last character stands apart from those before it.
    """
    kind = _classes()[points]
    n = len(points)
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    start = run.copy()
    # Ends of white-space runs that something of the same text follows: that character starts a match.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last
    after_blank = np.zeros(n, bool)
    after_blank[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~after_blank
    # Contractions: an apostrophe that starts a match, and letters right after it.
    at = np.flatnonzero(start & (points == 39))
    if len(at):
        follow = np.concatenate([points, [0, 0]])
        ends = np.concatenate([first, [True, True]])
        a, b = follow[at + 1], follow[at + 2]
        one = np.isin(a, [115, 116, 109, 100]) & ~ends[at + 1]
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~ends[at + 1] & ~ends[at + 2]
        for hit, length in ((one, 2), (two, 3)):
            start[at[hit] + 1] = False
            rest = at[hit] + length
            rest = rest[rest < n]
            start[rest] = True
    return np.flatnonzero(start)


def _pieces(column, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte start of each pre-token and the end, pre-token count of each text)."""
    data, offsets = text_bytes(column)
    if pattern != BYTE_LEVEL:
        split = regex.compile(pattern)
        found = [[m.end() - m.start() and len(m[0].encode()) for m in split.finditer(t or "")] for t in column.to_pylist()]
        return data, np.concatenate([[0], np.cumsum([n for f in found for n in f])]).astype(np.int64), np.array([len(f) for f in found])
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    begin = np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])
    first[begin] = True
    starts = at[cuts(points, first)] if len(points) else np.zeros(0, np.int64)
    return data, np.append(starts, len(data)), np.diff(np.searchsorted(starts, offsets))


class _Known:
    """Pre-tokens a worker has met, by 64-bit hash, with their ids in one array."""

    def __init__(self):
        self.hash, self.start, self.length, self.ids = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int32))

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        start = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, ids])
        both = np.concatenate([self.hash, hashes])
        by = np.argsort(both, kind="stable")
        self.hash, self.start, self.length = both[by], np.concatenate([self.start, start])[by], np.concatenate([self.length, lengths])[by]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it isn't there."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where(self.hash[at] == hashes, at, -1)


_known: dict[tuple[str, str], _Known] = {}


def encode_column(column, path: str, pattern: str) -> list[np.ndarray]:
    """Ids of each text of an Arrow column; each match of the pattern is encoded by itself.

    Equal pre-tokens of a block are found by hash and encoded once. What the ids of a text decode to is
    compared with it, and a text that differs (two pre-tokens with one hash) is encoded by itself.
    """
    vocab = vocabulary(path)
    known = _known.setdefault((path, pattern), _Known())
    if len(known.hash) > KEEP:
        known = _known[path, pattern] = _Known()
    data, bounds, counts = _pieces(column, pattern)
    if len(bounds) < 2:
        return [np.zeros(0, np.int32) for _ in counts]
    lengths = np.diff(bounds)
    hashes = _run_hashes(data, bounds[:-1], lengths)
    unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    missing = np.flatnonzero(known.find(unique) < 0)
    if len(missing):
        raw = data.tobytes()
        ids, sizes = vocab.encode_flat([raw[a : a + n] for a, n in zip(bounds[first[missing]].tolist(), lengths[first[missing]].tolist(), strict=True)])
        known.add(unique[missing], sizes, ids)
    at = known.find(unique)
    size = known.length[at][which]
    ends = np.cumsum(size)
    ids = known.ids[np.repeat(known.start[at][which] - (ends - size), size) + np.arange(ends[-1])]
    by_text = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [ids[a:b] for a, b in zip(by_text, by_text[1:], strict=False)]


def _run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    powers = powers_of(int(place.max()) + 1)
    return mix64(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * powers[place], starts) + lengths.astype(np.uint64))


def encode_alone(text: str, path: str, pattern: str) -> list[int]:
    """Ids of one text by the pattern's own engine and no hashes."""
    return list(chain.from_iterable(vocabulary(path).encode([m[0].encode() for m in regex.finditer(pattern, text)])))


def bpe(docs: DataFrame, text: str, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """The columns, with n_tokens, ids_sha256 and decoded_sha256 of each text.

    Null texts are empty: no tokens, the hashes of empty strings. Texts of any length are encoded whole;
    equal texts get equal values, repeated rows a row each; an empty table gives no rows. Where one of
    the columns has the name of a new one, the new one takes _ before its name.
    """
    names = fresh(columns, "n_tokens", "ids_sha256", "decoded_sha256")
    schema = schema_of(docs, columns) + "`{}` long, `{}` string, `{}` string".format(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for start, column in blocks(whole.column(text), 1 << 22):
                b = whole.slice(start, len(column))
                count, ids, back = [], [], []
                for t, r in zip(column.to_pylist(), encode_column(column, path, pattern), strict=True):
                    r, raw = r.tolist(), (t or "").encode()
                    if (got := vocab.decode(r)) != raw:
                        r = encode_alone(t, path, pattern)
                        got = vocab.decode(r)
                    count.append(len(r))
                    ids.append(hashlib.sha256(" ".join(map(vocab.text_of.__getitem__, r)).encode()).hexdigest())
                    back.append(hashlib.sha256(got).hexdigest())
                n = pa.array(count, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), n, pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[*columns, *names])

    return docs.select(*columns, *([text] if text not in columns else [])).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as p

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe(docs, "text", p.path("byte_bpe_50k.tiktoken"), p.PATTERN, ["doc_id"])
