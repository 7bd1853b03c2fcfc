"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts are multisets of shingles of five words, hashed; a shingle weighs its count times its inverse
document frequency. Samples are consistent: two texts share one with a probability of their weighted
Jaccard similarity. Bands of samples give buckets; every two texts of a bucket end in one class or have
been compared by exact weighted Jaccard similarity of the whole texts.

Document frequencies count each crowd of near copies once: a text counts by 1 / the size of its crowd.
Otherwise the words that a large group of near copies has in common would weigh as little as boilerplate,
and the few words that differ would part the group. Crowd sizes come from unweighted minimum hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.llm.common import release, stage, table
from braidlake.llm.slots import counted
from braidlake.llm.words import LOWER, blocks, mix64, shingle_hashes, text_bytes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: Counts of shingles, and of crowds, are kept in 2^BITS slots: tables of fixed size, whatever the corpus.
BITS = 20
#: Bands of two minimum hashes that tell a text's crowd.
CROWD_BANDS = 8
#: A text counts for ONE in a slot, or for its crowd's share of it; whole numbers add up alike in any order.
ONE = 1 << 20
#: Shingles of some such number of crowds weigh nearly as much as those of one.
SMOOTH = 16.0
#: Texts, and bytes of text, in a block of a large bucket; two blocks meet in a task.
BLOCK, BLOCK_BYTES = 512, 1 << 21
#: Shingles in a dense matrix at once, and texts with a shingle up to which it is not worth one.
DENSE, RARE = 4096, 16
#: Bits of the map of texts that are looked up.
FILTER_BITS = 24


def shingles(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different shingles of each text in order, their counts, first one of each text and one more); ASCII case is ignored."""
    data, offsets = text_bytes(column)
    h, first = shingle_hashes(LOWER[data], offsets, WIDTH)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(h)
    few = owner[order].astype(np.uint16 if len(first) < 1 << 16 else np.int64)
    order = order[np.argsort(few, kind="stable")]
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(owner[at], np.arange(len(first)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return count * idf[bucket(h)]


def inverse(df: np.ndarray, n: float) -> np.ndarray:
    """Inverse document frequencies, 1 at most; what other shingles add to a slot on average is taken off."""
    least = np.maximum(df - df.sum() / len(df), 1) + SMOOTH
    return np.log1p(n / least) / np.log1p(max(n, 1) / (1 + SMOOTH))


def crowd_slots(column) -> tuple[np.ndarray, np.ndarray]:
    """(texts with words, (those texts, CROWD_BANDS) slots of their bands of unweighted minimum hashes)."""
    data, offsets = text_bytes(column)
    h, first = shingle_hashes(LOWER[data], offsets, WIDTH)
    full = np.flatnonzero(first[:-1] < first[1:])
    out = np.zeros((len(full), CROWD_BANDS), np.int64)
    odd = mix64(np.arange(1001, 1001 + 2 * CROWD_BANDS, dtype=np.uint64)) | np.uint64(1)
    for k in range(CROWD_BANDS if len(full) else 0):
        one, two = (np.minimum.reduceat(h * o, first[full]) for o in odd[2 * k : 2 * k + 2])
        out[:, k] = bucket(mix64(mix64(one + np.uint64(k)) ^ two))
    return full, out


def crowd_weights(column, crowds: np.ndarray) -> np.ndarray:
    """What each text counts for: ONE, or ONE by the size of its crowd, where that stands out of what chance puts into a slot."""
    full, slots = crowd_slots(column)
    mean = crowds.sum() / len(crowds) / ONE
    size = crowds[slots].max(axis=1, initial=0) / ONE - mean
    size = np.where(size > 6 * np.sqrt(mean) + 1, size, 1)
    out = np.full(len(column), ONE, np.int64)
    out[full] = np.maximum(ONE / size, 1).astype(np.int64)
    return out


class Sampler:
    """ICWS: of weight w at key k, t = floor(ln w / r + b), ln a = ln c - r (t + 1 - b); the key of least a is the sample.

    r and c are Gamma(2, 1), b is uniform, by k and the number of the sample. They come from tables of
    65,536 quantile draws, picked by bits of a product with k. The least ln a itself is the sample's value: it depends on k and t alone.
    """

    def __init__(self, n: int, seed: int = 7):
        g = np.random.default_rng(seed)
        draw = lambda: -np.log(g.random(1 << 16) * g.random(1 << 16) + 1e-30)
        self.r, self.c, self.b = draw().astype(np.float32), np.log(draw()).astype(np.float32), g.random(1 << 16).astype(np.float32)
        self.odd = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)

    def sample(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, samples) as 32-bit values; texts without shingles have 0."""
        out = np.zeros((len(first) - 1, len(self.odd)), np.uint32)
        full = np.flatnonzero(first[:-1] < first[1:])
        if not len(full):
            return out
        ln_w, starts = np.log(w).astype(np.float32), first[full]
        for i, odd in enumerate(self.odd):
            z = h * odd
            r = self.r[z >> np.uint64(48)]
            b = self.b[(z >> np.uint64(32)) & np.uint64(0xFFFF)]
            t = np.floor(ln_w / r + b)
            t += 1
            t -= b
            t *= r
            out[full, i] = np.minimum.reduceat(self.c[(z >> np.uint64(16)) & np.uint64(0xFFFF)] - t, starts).view(np.uint32)
        return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) 64-bit keys, different for each band."""
    out = np.zeros((len(samples), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(samples), k + 1, np.uint64)
        for j in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, k * ROWS + j])
        out[:, k] = key
    return out.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The inverse document frequency of each slot, over all rows, in two passes: sizes of crowds, then shingles."""
    spark = docs.sparkSession

    def crowded(batch) -> tuple[np.ndarray, np.ndarray]:
        _, slots = crowd_slots(batch.column(text))
        return slots.reshape(-1), np.full(slots.size, ONE, np.int64)

    crowds = counted(docs.select(text), text, crowded, BITS)
    shared = spark.sparkContext.broadcast(crowds)

    def weighed(batch) -> tuple[np.ndarray, np.ndarray]:
        h, _, first = shingles(batch.column(text))
        return bucket(h), np.repeat(crowd_weights(batch.column(text), shared.value), np.diff(first))

    df = counted(docs.select(text), text, weighed, BITS)
    return inverse(df / ONE, crowds.sum() / ONE / CROWD_BANDS)


def row_key(id_: Column, text: Column) -> Column:
    """16 bytes that are a text's own; 17 that are the id's where the text is null."""
    return F.coalesce(F.unhex(F.md5(text)), F.unhex(F.concat(F.lit("00"), F.md5(id_.cast("string")))))


def _signed(docs: DataFrame, idf) -> DataFrame:
    """docs(id, key, text) with `w`, a text's weight, and `bands` in place of the text; null texts and such without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(BANDS * ROWS)
        for whole in batches:
            for start, part in blocks(whole.column("text"), 1 << 18):
                b = whole.slice(start, len(part))
                h, count, first = shingles(part)
                w, n = weights(h, count, idf.value), np.diff(first)
                total = np.bincount(np.repeat(np.arange(len(n)), n), w, len(n))
                keys = band_keys(sampler.sample(h, w, first))[n > 0]
                at = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("bytes"), pa.array(total, pa.float64()), bands], names=["id", "key", "bytes", "w", "bands"])

    return docs.select("id", "key", F.octet_length("text").alias("bytes"), "text").mapInArrow(run, "id long, key binary, bytes int, w double, bands array<long>")


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) once for each of keys(key), of docs(key, text), and a few others.

    Only a bitmap of 2^FILTER_BITS hashed keys is broadcast; it keeps most other texts out of the shuffle.
    """
    place = lambda: F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS))
    slots = keys.select(place().alias("p"))
    found = slots.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in found.toLocalIterator():
        bitmap[r["w"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def wanted(p: pa.Array) -> pa.Array:
        at = p.to_numpy()
        return pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return docs.select("key", "text").where(wanted(place())).groupBy("key").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; texts(key, text) has a key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, tuple | None] = (None, None)
        for whole in batches:
            keep = np.zeros(whole.num_rows, bool)
            for start, part in blocks(whole.column("text_a"), 1 << 18):
                two = whole.column("text_b").slice(start, len(part))
                h, count, first = shingles(part)
                w = weights(h, count, idf.value)
                for i, b in enumerate(whole.column("b").slice(start, len(part)).to_pylist()):
                    if last[0] != b:
                        g, c, _ = shingles(two.slice(i, 1))
                        last = (b, (g, weights(g, c, idf.value)))
                    x, y = first[i], first[i + 1]
                    keep[start + i] = jaccard((h[x:y], w[x:y]), last[1]) >= similarity - 1e-9
            yield whole.select(["a", "b"]).filter(pa.array(keep))

    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, label) of each key of the edges (a, b): keys have one label if a path of edges joins them, and the label is a key among them.

    In each turn a key goes to the least key next to it or itself, and edges with it; keys are hashes, so
    the order is random and a constant part of the keys goes away, until no edge is left. Every turn is written.
    """
    labels, own = None, []
    while True:
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        step = stage(ends.select("e.*").groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        moved = edges.join(step.withColumnRenamed("to", "x"), "a").select("x", "b").join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        left = stage(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if labels is None:
            labels = stage(step.select(F.col("a").alias("key"), F.col("to").alias("label")))
        else:
            grown = stage(labels.join(step.withColumnRenamed("a", "label"), "label", "left").select("key", F.coalesce("to", "label").alias("label")))
            release(labels)
            labels = grown
        release(step, *own)
        edges, own = left, [left]
        if edges.isEmpty():
            release(edges)
            return labels


def _meetings(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(band, i, j, place, key, label): the texts of place i and of place j of a bucket, for all i <= j whose texts are to be compared.

    Members are (band, key, label, w, bytes). Any two of different labels meet, unless the greater weighs
    more than 1 / similarity times the lesser, which rules out that they are similar. A bucket of one
    block is one place. In a larger one, texts of about a weight are places of a block each, and those of
    the bucket's most frequent label have places of their own, which meet those of the others only.
    """
    by_label = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    most = F.struct("n", "label")
    buckets = by_label.groupBy("band").agg(F.max_by("label", most).alias("main"), F.max("n").alias("main_n"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks_of = lambda n, size: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    buckets = stage(buckets.where("n > main_n").select("band", "main", (blocks_of(F.col("n"), F.col("size")) > 1).alias("large")))
    level = F.floor(F.log(F.greatest("w", F.lit(1e-9))) / F.log(F.lit(1 / similarity))).cast("int")
    m = members.join(buckets, "band").select("band", "key", "label", "bytes", F.when(F.col("large"), level).otherwise(0).alias("level"), (F.col("large") & (F.col("label") == F.col("main"))).alias("own"))
    m = stage(m)
    sized = m.groupBy("band", "level", "own").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size")).withColumn("blocks", blocks_of(F.col("n"), F.col("size")))
    # Levels of weight are some dozens whatever the bucket's size.
    plan = stage(sized.groupBy("band").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("level", "own").alias("k"), F.col("blocks").alias("v")))).alias("plan")))
    met = m.join(plan, "band")
    blocks_at = lambda at, own: F.coalesce(F.try_element_at("plan", F.struct(at.cast("int").alias("level"), own.alias("own"))), F.lit(0))
    place = lambda at, own, sub: ((at + F.lit(1000)) * 2 + own.cast("int")).cast("long") * (1 << 20) + sub
    mine = place(F.col("level"), F.col("own"), F.pmod(F.xxhash64("key"), blocks_at(F.col("level"), F.col("own"))))

    def others(by: int, own: bool) -> Column:
        at = F.col("level") + by
        n = F.when(F.col("own") & F.lit(own), 0).otherwise(blocks_at(at, F.lit(own)))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda s: place(at, F.lit(own), s))).otherwise(F.array().cast("array<bigint>"))

    to = [others(by, own) for by in (-1, 0, 1) for own in (False, True)]
    met = met.select("band", "key", "label", mine.alias("place"), F.explode(F.concat(*to)).alias("other"))
    return met.select("band", F.least("place", "other").alias("i"), F.greatest("place", "other").alias("j"), "place", "key", "label")


def shared_weight(h: np.ndarray, count: np.ndarray, first: np.ndarray, idf: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """(rows, cols) 32-bit sums of the lesser weights of the shingles that two texts share."""
    n = len(first) - 1
    owner = np.repeat(np.repeat(np.arange(n), np.diff(first)), count)
    # A shingle's repetitions count as others, so that each key has one weight and is in a text once.
    level = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    value = np.repeat(h, count)
    key = np.where(level > 0, mix64(value ^ (level * np.uint64(0x9E3779B97F4A7C15))), value)
    order = np.argsort(key, kind="stable")
    key, owner, w = key[order], owner[order], idf[bucket(value[order])].astype(np.float32)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    df = np.diff(np.append(starts, len(key)))
    at_row, at_col = np.full(n, -1), np.full(n, -1)
    at_row[rows], at_col[cols] = np.arange(len(rows)), np.arange(len(cols))
    out = np.zeros((len(rows), len(cols)), np.float32)
    every = np.repeat(df, df)
    some = np.flatnonzero((every > 1) & (every <= RARE))
    for step in range(1, RARE):
        one = some[:-step]
        two = one + step
        same = (two < len(key)) & (key[np.minimum(two, len(key) - 1)] == key[one])
        one, two = one[same], two[same]
        if not len(one):
            break
        for x, y in ((owner[one], owner[two]), (owner[two], owner[one])):
            ok = (at_row[x] >= 0) & (at_col[y] >= 0)
            np.add.at(out, (at_row[x[ok]], at_col[y[ok]]), w[one[ok]])
    dense = np.flatnonzero(every > RARE)
    column = np.repeat(np.cumsum(df > RARE) - 1, df)[dense]
    owner, root = owner[dense], np.sqrt(w[dense])
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, DENSE):
        lo, hi = np.searchsorted(column, [start, start + DENSE])
        x = np.zeros((n, min(DENSE, int(column[-1]) + 1 - start)), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = root[lo:hi]
        out += x[rows] @ x[cols].T
    return out


def linked(texts, label: np.ndarray, place: np.ndarray, idf: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Near pairs of texts of different labels (and places, where there are two): enough to link all labels that such pairs link."""
    _, root = np.unique(label, return_inverse=True)
    rows, cols = np.flatnonzero(place == place.min()), np.flatnonzero(place == place.max())
    if len(np.unique(root)) < 2:
        return []
    parts = [shingles(part) for _, part in blocks(texts, 1 << 18)]
    h, count = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    w = weights(h, count, idf)
    total = np.bincount(np.repeat(np.arange(len(first) - 1), np.diff(first)), w, len(first) - 1)
    share = shared_weight(h, count, first, idf, rows, cols)
    # 32-bit sums only choose what is verified.
    maybe = share >= (similarity - 1e-3) * (total[rows][:, None] + total[cols][None, :] - share)
    out = []
    for r, row in enumerate(rows.tolist()):
        near = cols[np.flatnonzero(maybe[r])]
        near = near[root[near] != root[row]]
        while len(near):
            c, near = int(near[0]), near[1:]
            a, b = ((h[first[x] : first[x + 1]], w[first[x] : first[x + 1]]) for x in (row, c))
            if jaccard(a, b) >= similarity - 1e-9:
                out.append((row, c))
                root[root == root[c]] = root[row]
                near = near[root[near] != root[row]]
    return out


def _closed(meetings: DataFrame, texts: DataFrame, idf, similarity: float) -> DataFrame:
    """(a, b) labels of near texts that meet and have different labels; texts(key, text) has a key once."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        codes = group["label"].combine_chunks().dictionary_encode()
        found = np.array(linked(group["text"], codes.indices.to_numpy(), group["place"].to_numpy(), idf.value, similarity), np.int64).reshape(-1, 2)
        return pa.table({c: group["label"].take(pa.array(found[:, i])) for i, c in enumerate("ab")}, schema=pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    met = meetings.join(texts, "key").select("band", "i", "j", "place", "key", "label", "text")
    return met.groupBy("band", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, rep, class_id, first) of each row: key tells the text, rep is the least id with the same text, class_id the
    least one of all that near-duplicate links lead to; first is true for the class's text of that id (the
    one of the least key, should an id have several), and false for all others.

    Null texts are in no class but their own id's; empty texts, and others without words, are copies of
    equal ones but near none; a text of fewer than five words is one shingle. Rows that repeat an id with
    the same text are copies of each other, and each has its row; different texts under one id are
    compared as any others, but their classes have that id in common where it is the least of both. Rows
    without an id are left out. An empty table gives no rows. Only the two named columns are read, so
    others may have any names. Any two texts with a bucket in common are in one class or have been
    compared, whatever the bucket's size; those of a large bucket whose weights rule it out are not.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL")
    d = d.withColumn("key", row_key(F.col("id"), F.col("text")))
    idf = spark.sparkContext.broadcast(inverse_frequencies(d, "text"))  # 2^BITS numbers
    rows = stage(_signed(d, idf))
    reps = stage(rows.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"), F.first("w").alias("w")))
    each = reps.select("key", "bytes", "w", F.explode("bands").alias("band"))
    sizes = stage(each.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("head")).where("n > 1"))
    members = stage(each.join(sizes, "band"))
    texts = stage(_texts_of(d.where("text IS NOT NULL"), members.select("key")))
    # Each member with its bucket's head: what large groups of copies have in common is settled in linear work.
    links = stage(_verified(members.where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct(), texts, idf, similarity))
    labels = components(links)
    # Then what no link has brought into one class; two members have been compared already.
    wide = members.where("n > 2").select("band", "key", "bytes", "w").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    wide = stage(wide)
    more = stage(_closed(_meetings(wide, similarity), texts, idf, similarity))
    merged = components(more)
    to = merged.select(F.col("key").alias("label"), F.col("label").alias("to"))
    known = reps.select("key", "rep").join(labels, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    known = stage(known.join(to, "label", "left").select("key", "rep", F.coalesce("to", "label").alias("label")))
    least = known.groupBy("label").agg(F.min(F.struct("rep", "key")).alias("least"))
    classes = stage(known.join(least, "label").select("key", "rep", F.col("least.rep").alias("class_id"), (F.col("least.key") == F.col("key")).alias("is_first")))
    release(reps, sizes, members, texts, links, labels, wide, more, merged, known)
    got = rows.select("id", "key").join(classes, "key")
    return got.select("id", "key", "rep", "class_id", (F.col("is_first") & (F.col("id") == F.col("class_id"))).alias("first"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document; copies and near copies have the class_id in common."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "rep", "class_id")
