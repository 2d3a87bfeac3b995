"""Near-duplicate classes: consistent weighted sampling over TF-IDF word shingles.

Weights. A document is a weighted set of its runs of five words: term frequency times a
normalised inverse document frequency, from 1 for a shingle of all documents to 2 for one of
at most the share FREQUENT of them. (With unbounded idf, a group of thousands of copies
would make its own text common and its few edits heavy, and so fall apart.) Frequencies of
shingles that reach that share are exact: a first pass counts all shingles in ``2**DF_BITS``
hashed buckets, a second one counts, by shuffle, those whose bucket is heavy enough. The
table of frequent shingles has at most (shingles per document) / FREQUENT entries, and the
weights mean the same at any size of corpus.

Candidates. Improved consistent weighted sampling (Ioffe 2010) draws BANDS * ROWS samples a
text; two texts agree in one with the probability of their weighted Jaccard similarity.
Texts that agree in all ROWS of a band share a bucket: at similarity 0.8 a pair is missed
with probability (1 - 0.8**3)**12 = 0.0002.

Verification. Equal texts are one node. In each bucket all members are compared with one
pivot, the exact weighted Jaccard similarity deciding; linked nodes are one component. The
pivot is the member that shares its buckets with the most texts: in a group of copies, the
one with the fewest edits, and so mostly the same one in all bands. Only buckets that then
hold several components stay open; those with one pivot are one group. A member leaves if
what it alone holds of all open texts is over ``1 - threshold`` of its weight, which bounds
its similarity with any of them. What is left of a group is compared whole, block by block:
a task gets the texts of two blocks and takes all similarities as one matrix, and returns at
most one link a text. So no link within a bucket is lost, no pair becomes a row, copies that
the pivot links cost one comparison each, and only what is neither linked nor ruled out is
compared with all of its group.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._names import fresh
from ._repeats import mark, marked
from ._scratch import Scratch
from ._sums import summed
from ._text import Words, chunks, mix, prefix_sums, signed, span_hashes

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
DF_BITS = 20
#: Share of the documents from which on a shingle's weight is below 2.
FREQUENT = 1 / 1000
#: Members of a pivot that one run of rows holds.
SALTED = 256
#: Members of a block, about, and their bytes.
BLOCK, BLOCK_BYTES = 768, 1 << 21
#: Similarities are sums of floats, in no fixed order.
ROUNDING = 1e-9
_DF_CHUNK = 4096
_RARE, _COLUMNS = 16, 1024


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each row's distinct runs of ``size`` words, by row and hash.

    A text of fewer words has one shingle, all its words; a text without words has none.
    """
    words = Words(data, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = prefix_sums(words.hashes)
    counts = np.diff(words.bounds)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    start = words.bounds[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = span_hashes(sums, start, np.minimum(start + size, words.bounds[row + 1]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - DF_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Number of documents by hashed bucket of their distinct shingles; the table has ``2**DF_BITS`` entries."""

    def count(batches):
        seen = np.zeros(1 << DF_BITS, np.int32)
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                np.add.at(seen, _bucket(shingles(data, offsets, size)[1]), 1)
        parts = seen.reshape(-1, _DF_CHUNK)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[i].astype(np.int64).tobytes() for i in some], pa.binary())], ["chunk", "counts"])

    out = np.zeros((1 << DF_BITS) // _DF_CHUNK * _DF_CHUNK, np.int64).reshape(-1, _DF_CHUNK)
    rows = summed(docs.select("text").mapInArrow(count, "chunk long, counts binary"), np.int64)
    for r in rows.collect():  # 8 MB
        out[r["chunk"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out.ravel()


@dataclass
class Weights:
    """Inverse document frequencies: those of the frequent shingles, by sorted hash; all others weigh 2."""

    hashes: np.ndarray
    values: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), 2.0)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.values[at], 2.0)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    """From 1 for df = n to 2 for df of at most FREQUENT * n."""
    least = FREQUENT * n
    return 1 + np.log((n + 1) / (np.clip(df, least, n) + 1)) / np.log((n + 1) / (least + 1))


def shingle_weights(docs: DataFrame, size: int, n: int) -> Weights:
    """Weights of the shingles of ``docs`` (text), n documents; repeated texts count as often as they come."""
    least = max(2, int(np.ceil(FREQUENT * n)))
    heavy = docs.sparkSession.sparkContext.broadcast(np.packbits(document_frequencies(docs, size) >= least))

    def count(batches):
        some = np.unpackbits(heavy.value).astype(bool)
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                h = shingles(data, offsets, size)[1]
                h, n = np.unique(h[some[_bucket(h)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(h), pa.array(n)], ["h", "n"])

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counted.collect()  # at most (shingles per document) / FREQUENT
    h = np.array([r["h"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Weights(h[order], inverse_frequency(np.array([r["n"] for r in rows], np.float64), max(n, 1))[order])


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of 65536 equal shares of probability."""
    x = np.concatenate([np.linspace(0, 1, 200_001)[:-1] ** 2, np.linspace(1, 30, 400_001)])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - np.exp(-x) * (1 + x), x)


_tables: list[np.ndarray] = []


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, n_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have shingles, their samples): improved consistent weighted sampling.

    Each sample is a 32-bit hash of the drawn shingle and its quantised weight. The random
    variables r, c and beta of a shingle come from its hash and the sample's number.
    """
    if not _tables:
        q = _gamma_quantiles()
        _tables.extend([q.astype(np.float32), np.log(q).astype(np.float32)])
    gamma, log_gamma = _tables
    head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    out = np.zeros((len(head), n_samples), np.uint32)
    if not len(row):
        return row, out
    log_weight = np.log(weight).astype(np.float32)
    for j in range(n_samples):
        u = mix(h, j + 1)
        low = (u & np.uint64(0xFFFF)).astype(np.int32)
        r = gamma[low]
        c = log_gamma[((u >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)]
        beta = (u >> np.uint64(32)).astype(np.float32) * np.float32(2**-32)
        t = np.floor(log_weight / r + beta)
        a = c - r * (t - beta + np.float32(1))
        bits = a.view(np.uint32)
        bits = np.where(a < 0, ~bits, bits | np.uint32(0x80000000))
        name = (u ^ (t.astype(np.int32).astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)
        out[:, j] = (np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | name, head) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return row[head], out


def band_keys(drawn: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(drawn), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(drawn), b + 1, np.uint64)
        for i in range(rows):
            k = mix(k ^ drawn[:, b * rows + i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), i)
        keys[:, b] = k
    return keys


def _verify(pairs: DataFrame, texts: DataFrame, idf, size: int) -> DataFrame:
    """(a, b, similarity) of pairs (a, b): each a's text meets its b's in runs of at most SALTED or so."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / SALTED).cast("int")
    members = pairs.join(counts, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    members = members.join(texts, "node").select("a", "salt", F.lit(1).alias("side"), F.col("node").alias("b"), "text")
    pivots = counts.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")).join(texts.select(F.col("node").alias("a"), "text"), "a")
    pivots = pivots.select("a", "salt", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    rows = pivots.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")

    def compare(batches):
        pivot, ph, pw, total = None, None, None, 0.0
        for b in batches:
            a, salt, side = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            upto = 0
            while upto < len(a):
                if side[upto] == 0:
                    pivot = (a[upto], salt[upto])
                    for _, _, data, offsets in chunks(b.column(4).slice(upto, 1)):
                        _, ph, count = shingles(data, offsets, size)
                        pw = count * idf.value.of(ph)
                        total = pw.sum()
                    upto += 1
                    continue
                end = upto
                while end < len(a) and side[end] == 1 and (a[end], salt[end]) == pivot:
                    end += 1
                if end == upto:
                    raise RuntimeError("a pair lacks its first text")
                similar = np.zeros(end - upto)
                for first, last, data, offsets in chunks(b.column(4).slice(upto, end - upto)):
                    row, h, count = shingles(data, offsets, size)
                    w = count * idf.value.of(h)
                    n = last - first
                    own = np.bincount(row, w, n)
                    if len(ph) and len(h):
                        at = np.minimum(np.searchsorted(ph, h), len(ph) - 1)
                        shared = np.bincount(row, np.where(ph[at] == h, np.minimum(w, pw[at]), 0.0), n)
                    else:
                        shared = np.zeros(n)
                    union = own + total - shared
                    similar[first:last] = np.where(union > 0, shared / np.maximum(union, 1e-300), 1.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(upto, end - upto), b.column(3).slice(upto, end - upto), pa.array(similar)], ["a", "b", "similarity"])
                upto = end

    return rows.mapInArrow(compare, "a binary, b binary, similarity double")


def text_node(column: Column) -> Column:
    """16 bytes that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))


def near_duplicate_classes(
    docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, class_id, node, class_size): each row's class of near duplicates.

    Two texts are linked if the weighted Jaccard similarity of their shingles is at least
    ``threshold`` or they are equal; classes are the components of the links. class_id is the
    least id of the class (null if all its ids are). Null texts count as empty, and empty
    texts are equal to each other and linked to nothing else. Texts of fewer than ``size``
    words have one shingle, all their words. Repeated rows are rows of one class. Other
    columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    nodes = scratch.save(own.select("id", text_node(F.col("text")).alias("node")), "nodes")
    idf = spark.sparkContext.broadcast(shingle_weights(own, size, nodes.count()))

    def sign(batches):
        seen: set[bytes] = set()  # copies within a task are signed once; the bound is for memory only
        for b in batches:
            for first, last, data, offsets in chunks(b.column(0)):
                raw = data.tobytes()
                names = [hashlib.md5(raw[x:y]).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                row, h, count = shingles(data, offsets, size)
                fresh = np.zeros(last - first, bool)
                for i, name in enumerate(names):
                    if name not in seen:
                        fresh[i] = True
                        if len(seen) < 100_000:
                            seen.add(name)
                keep = fresh[row]
                row, h, count = row[keep], h[keep], count[keep]
                have, drawn = samples(row, h, count * idf.value.of(h), last - first, bands * rows)
                keys = band_keys(drawn, bands, rows)
                upto = pa.array(np.arange(len(have) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in have], pa.binary()), pa.ListArray.from_arrays(upto, signed(keys.ravel()))], ["node", "keys"])

    signed_rows = scratch.save(own.select("text").mapInArrow(sign, "node binary, keys array<long>").dropDuplicates(["node"]), "signed")
    members = signed_rows.select("node", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = scratch.save(members.join(shared, "bucket"), "shared")
    scratch.drop("signed")
    # How many texts share a text's buckets: most for the one with the fewest edits in a group of copies.
    scores = buckets.groupBy("node").agg(F.sum("n").alias("score"))
    buckets = scratch.save(buckets.select("bucket", "node").join(scores, "node"), "scored")
    scratch.drop("shared")

    # Texts of the candidates. The bitmap only spares the others the shuffle.
    wanted = buckets.select("node").distinct()
    bits = spark.sparkContext.broadcast(mark(wanted.select(F.xxhash64("node").alias("h")), "h"))

    def candidates(batches):
        for b in batches:
            hit = marked(bits.value, b.column(2).to_numpy().view(np.uint64))
            yield b.filter(pa.array(hit))

    texts = own.select(text_node(F.col("text")).alias("node"), "text").withColumn("h", F.xxhash64("node")).mapInArrow(candidates, "node binary, text string, h long").drop("h")
    texts = scratch.save(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")

    pivots = buckets.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("a"))
    paired = buckets.join(pivots, "bucket")
    pairs = scratch.save(paired.filter("a <> node").select("a", F.col("node").alias("b")).distinct(), "pairs")
    links = scratch.save(_verify(pairs, texts, idf, size).filter(F.col("similarity") >= threshold - ROUNDING), "links")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, "components")
    labelled = nodes.join(roots, F.col("node") == F.col("u"), "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    # A node without links is a component of its own.
    groups = _several(paired.select("bucket", "a", "node").join(roots, F.col("node") == F.col("u"), "left").withColumn("root", F.coalesce("root", "node")), "bucket")
    groups = scratch.save(groups.select("a", "node", "root").distinct(), "open")
    if not groups.isEmpty():
        profile = scratch.save(_profile(groups, texts, idf, size), "profile")
        groups = scratch.save(_several(groups.join(profile.filter(F.col("own") <= (1 - threshold + ROUNDING) * F.col("w")).select("node"), "node"), "a"), "groups")
        edges = scratch.save(_compared(groups, texts, idf, size, threshold), "edges")
        merged = components(edges, scratch, "merged").select(F.col("u").alias("old"), F.col("root").alias("new"))
        labelled = labelled.join(merged, F.col("root") == F.col("old"), "left").select("id", "node", F.coalesce("new", "root").alias("root"))
    classes = labelled.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(classes, "root").select("id", "class_id", "node", "class_size")


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The rows of the keys that hold several components."""
    some = rows.groupBy(key).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select(key)
    return rows.join(some, key)


def _compared(groups: DataFrame, texts: DataFrame, idf, size: int, threshold: float) -> DataFrame:
    """(u, v): roots that a link of two members of a group joins. groups: a, node, root; texts: node, text.

    A group is dealt out in blocks, and each pair of blocks is one unit of work; a member
    goes to as many as its group has blocks.
    """
    members = groups.join(texts, "node")
    sizes = members.groupBy("a").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    rows = members.join(sizes, "a").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("a", "root", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("a", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "root", "text")

    def links(roots: list[bytes], parts: list[pa.Array]):
        names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.array([names[r] for r in roots])
        if len(names) < 2:
            return
        row, h, count = _shingled(parts, size)
        linked = similarities(row, h, count, idf.value.of(h), len(roots)) >= threshold - ROUNDING
        linked |= root[:, None] == root
        label = np.arange(len(roots))
        while True:
            least = np.where(linked, label, len(roots)).min(1)
            if (least == label).all():
                break
            label = least
        pairs = {(roots[i], roots[j]) for i, j in enumerate(label) if root[i] != root[j]}
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in pairs], pa.binary()), pa.array([v for _, v in pairs], pa.binary())], ["u", "v"])

    def compare(batches):
        key, roots, parts = None, [], []
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for x, y in zip([0, *cuts], [*cuts, len(keys)]):
                if keys[x] != key:
                    if roots:
                        yield from links(roots, parts)
                    key, roots, parts = keys[x], [], []
                roots += b.column(3).slice(x, y - x).to_pylist()
                parts.append(b.column(4).slice(x, y - x))
        if roots:
            yield from links(roots, parts)

    return rows.repartition("a", "x", "y").sortWithinPartitions("a", "x", "y").mapInArrow(compare, "u binary, v binary").distinct()


def _shingled(parts: list[pa.Array], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingles() of several columns, rows numbered through."""
    out, base = [], 0
    for part in parts:
        for first, _, data, offsets in chunks(part):
            row, h, count = shingles(data, offsets, size)
            out.append((row + base + first, h, count))
        base += len(part)
    return tuple(np.concatenate(x) for x in zip(*out))


def similarities(row: np.ndarray, h: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarities of n rows, n by n; rows without shingles have 0.

    A shingle that comes k times counts as k items, so that shared weight is a sum over shared items.
    """
    total = np.bincount(row, count * idf, n)
    times = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item = mix(np.repeat(h, count) + mix(times.astype(np.uint64), 11))
    own, weight = np.repeat(row, count), np.repeat(idf, count)
    order = np.argsort(item, kind="stable")
    item, own, weight = item[order], own[order], weight[order]
    head = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(item)))
    common = np.repeat(sizes > _RARE, sizes)
    shared = np.zeros(n * n)
    rare_item, rare_own, rare_weight = item[~common], own[~common], weight[~common]
    for step in range(1, _RARE):
        same = np.flatnonzero(rare_item[:-step] == rare_item[step:])
        if not len(same):
            break
        shared += np.bincount(rare_own[same] * n + rare_own[same + step], rare_weight[same], n * n)
    shared = shared.reshape(n, n)
    shared += shared.T
    columns = np.repeat(np.arange((sizes > _RARE).sum()), sizes[sizes > _RARE])
    own, weight = own[common], weight[common]
    for first in range(0, int(columns[-1]) + 1 if len(columns) else 0, _COLUMNS):
        x, y = np.searchsorted(columns, [first, first + _COLUMNS])
        table = np.zeros((n, _COLUMNS))
        table[own[x:y], columns[x:y] - first] = np.sqrt(weight[x:y])
        shared += table @ table.T
    union = total[:, None] + total - shared
    return np.where(union > 0, shared / np.maximum(union, 1e-300), 0.0)


def _profile(groups: DataFrame, texts: DataFrame, idf, size: int) -> DataFrame:
    """(node, w, own): a text's weight, and the weight of its shingles that no other of these texts holds.

    Which shingles several texts hold is kept in a bitmap; shared bits can only make ``own``
    smaller, so what is derived from it stays a bound.
    """
    open_texts = texts.join(groups.select("node").distinct(), "node", "left_semi")

    def names(batches):
        for b in batches:
            for _, _, data, offsets in chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([signed(shingles(data, offsets, size)[1])], ["h"])

    several = open_texts.mapInArrow(names, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    bits = texts.sparkSession.sparkContext.broadcast(mark(several, "h"))

    def weigh(batches):
        for b in batches:
            for first, last, data, offsets in chunks(b.column(1)):
                row, h, count = shingles(data, offsets, size)
                w = count * idf.value.of(h)
                n = last - first
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.bincount(row, w, n)), pa.array(np.bincount(row, np.where(marked(bits.value, h), 0.0, w), n))], ["node", "w", "own"])

    return open_texts.mapInArrow(weigh, "node binary, w double, own double")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, without those that have an earlier near duplicate.

    Of each class the rows with the least id stay, one of them; rows with a null id stay
    unless an equal text has an id.
    """
    classes = near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options)
    out = classes.filter(F.col("id").isNotNull() & (F.col("id") != F.col("class_id")) | F.col("id").isNull() & F.col("class_id").isNotNull())
    near_id, near_node = fresh("near_id", docs.columns), fresh("near_node", docs.columns)
    gone = out.select(F.col("id").alias(near_id), F.col("node").alias(near_node)).distinct()
    match = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(near_id)) & (text_node(F.col(f"`{text_col}`").cast("string")) == F.col(near_node))
    return docs.join(gone, match, "left_anti")
