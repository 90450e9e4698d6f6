"""SimHash near-dedup with pivot distance tables.

Texts become 64-bit fingerprints; fingerprints at a Hamming distance of at most
``radius`` are linked; a document's component is the smallest id it reaches.

1. Equal fingerprints collapse to one class, so exact copies cost one row.
2. Classes meet only where they share a key of ``blocks - radius`` whole blocks of
   bits: by the pigeonhole principle two fingerprints within the radius share one.
3. In a bucket, the distances of every fingerprint to the pivots form a table. A pair
   whose coordinates differ by more than the radius anywhere can't be within it
   (triangle inequality) and is discarded; survivors are verified by their own distance.
4. A bucket gives a spanning forest, not its pairs. Buckets over ``bucket_rows`` are dealt
   out as pairs of chunks, so that no task holds or walks a whole hot bucket.
5. Large-star and small-star rounds turn the links into components.

near_dedup() works on whole documents, at ``similarity`` (Jaccard) of their sets of word
shingles, where 64 bits tell too little: texts at 0.8 differ in 10 of 64 bits on average and
texts at 0.7 in 12. It takes fingerprints of 2,048 bits, linked within the expected distance
and a margin, and lets classes meet that share a key of least shingle hashes, as no key of
whole bits is selective at such distances. In a bucket the references are fingerprints of
the bucket itself; pairs are discarded by their distances to them and verified as above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, deleted, utf8, written

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text as an unsigned integer; 0 for a text without words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, seed)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    spans = zip((ends - lens)[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n - width + 1)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS
        out |= sum(1 << (8 * k + i) for i in range(8) if 2 * ones[i] > len(hashes))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and empty texts give 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make(batch: pa.RecordBatch) -> dict:
        fps = np.array([simhash(t, width) for t in utf8(batch.column(1))], np.uint64)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(by_batch(make, schema), "doc_id long, fp long")


def pivots(n: int) -> np.ndarray:
    """n reference fingerprints, from a fixed seed."""
    return np.random.default_rng(7).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def spanning_links(fps: np.ndarray, dist: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of one bucket's links, as pairs of positions: breadth first, each
    position compared only with those not reached yet. fps has a row of words for each position."""
    left = np.arange(len(fps))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.flatnonzero(np.abs(dist[left] - dist[at]).max(axis=1) <= radius)
            near = near[_distance(fps[left[near]], fps[at]) <= radius]
            if len(near):
                hit = left[near].tolist()
                out += [(at, h) for h in hit]
                front += hit
                left = np.delete(left, near)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _bucket_links(radius: int, n_pivots: int):
    """mapInArrow over rows (t, k, a, b, node, fp) sorted by bucket: the links within each bucket.
    Fingerprints of one word are held against fixed pivots, longer ones against some of their bucket."""
    names = ("t", "k", "a", "b")

    def table_of(fps: np.ndarray) -> np.ndarray:
        if fps.shape[1] == 1:
            return distance_table(fps[:, 0], pivots(n_pivots))
        refs = fps[np.linspace(0, len(fps) - 1, min(n_pivots, len(fps))).astype(int)]
        return np.stack([_distance(fps, r) for r in refs], axis=1)

    def links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(fps)]
        size = ends - starts
        left, right = [], []
        fixed = table_of(fps) if fps.shape[1] == 1 else None
        for n in range(2, 5):  # small buckets, all of a size at once
            at = starts[size == n]
            for i, j in combinations(range(n), 2):
                near = at[np.abs(fixed[at + i] - fixed[at + j]).max(axis=1) <= radius] if fixed is not None else at
                near = near[_distance(fps[near + i], fps[near + j]) <= radius]
                left.append(nodes[near + i])
                right.append(nodes[near + j])
        for s, e in zip(starts[size > 4].tolist(), ends[size > 4].tolist(), strict=True):
            pairs = np.array(spanning_links(fps[s:e], fixed[s:e] if fixed is not None else table_of(fps[s:e]), radius), np.int64).reshape(-1, 2) + s
            left.append(nodes[pairs[:, 0]])
            right.append(nodes[pairs[:, 1]])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            now = (
                np.stack([of(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1), of("node").to_numpy(zero_copy_only=False),
                np.frombuffer(b"".join(of("fp").to_pylist()), "<u8").reshape(batch.num_rows, -1),
            )
            held = now if held is None else tuple(map(np.concatenate, zip(held, now, strict=True)))
            keys = held[0]
            cut = int(np.flatnonzero(np.any(keys != keys[-1], axis=1)).max(initial=-1)) + 1  # the last bucket may go on
            if cut:
                yield links(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if held is not None:
            yield links(*held)

    return run


def dealt(rows: DataFrame, sizes: DataFrame, bucket_rows: int, how: str) -> DataFrame:
    """rows(t, k, node) with a, b: every row of a bucket of sizes(t, k, count) once for each chunk of
    it, so that any two rows of the bucket meet in a pair of chunks, and no pair holds more than
    twice ``bucket_rows``."""
    chunks = F.coalesce(F.ceil(F.col("count") / bucket_rows), F.lit(1)).cast("int")
    rows = rows.join(sizes, ["t", "k"], how).withColumn("c", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.select("node", "t", "k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))


def linked(rows: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    """(u, v) of rows(t, k, a, b, node, fp)."""
    bucket = ("t", "k", "a", "b")
    return rows.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(_bucket_links(radius, n_pivots), "u long, v long")


def near_links(classes: DataFrame, radius: int = 4, blocks: int = 6, n_pivots: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """(u, v): links between distinct fingerprints of ``classes(fp)`` that keep the connected
    components whole. More blocks mean longer keys and more tables: 6 give 15 keys of about
    21 bits; 8 give 70 of 32 bits, for more than about 10^10 distinct fingerprints."""
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)), b - a) for a, b in zip(bounds, bounds[1:], strict=False)]
    keys = [reduce(lambda x, i: F.shiftleft(x, part[i][1]).bitwiseOR(part[i][0]), c[1:], part[c[0]][0]) for c in combinations(range(blocks), blocks - radius)]
    rows = classes.select(F.col("fp").alias("node"), F.posexplode(F.array(*keys)).alias("t", "k"))
    hot = written(rows.groupBy("t", "k").count().filter(F.col("count") > bucket_rows), "hot-buckets")
    n_hot = hot.count()
    rows = dealt(rows, F.broadcast(hot) if n_hot <= 100_000 else hot, bucket_rows, "left")
    return linked(rows.withColumn("fp", F.unhex(F.lpad(F.hex("node"), 16, "0"))), radius, n_pivots)


def components(links: DataFrame) -> DataFrame:
    """(v, root): the smallest node reachable, for every node of links(u, v) but the roots.

    Alternates large-star (bigger neighbours go to the smallest one) and small-star (smaller
    neighbours do), until the links no longer change: then each is (root, node). Every round
    is a partial aggregation and a join of two written tables, which Spark splits where a
    node has very many links."""
    links = written(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u <> v")
        large = written(large.distinct(), "links")
        least = written(large.groupBy("v").agg(F.min("u").alias("m")), "low")
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).union(joined.select(F.col("m").alias("u"), "v"))
        before, links = links, written(small.filter("u <> v").distinct(), "links")
        for table in (before, low, large, least):
            deleted(table)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select("v", F.col("u").alias("root"))
        seen = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, blocks: int = 6, n_pivots: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Null or empty texts share fingerprint zero and are linked like any other. Repeated rows
    stay, each with its component. A null id is no candidate for component_id, which is null
    if no member has an id. An empty table gives no rows; other columns are ignored."""
    fps = written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(near_links(classes.select("fp"), radius, blocks, n_pivots, bucket_rows))
    linked = classes.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = written(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "lowest")
    ids = written(written(linked, "linked").join(lowest, "root").select("fp", "component_id"), "components")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


WORDS = 32  # of a long fingerprint, 64 bits each
KEYS, ROWS = 12, 4  # keys of a text, and least hashes in each: texts at Jaccard 0.8 share one with probability 0.998
_MIX = np.random.default_rng(17).integers(0, 1 << 64, (2, KEYS * ROWS + WORDS), np.uint64, endpoint=False) | np.uint64(1)


def long_fingerprint(text: bytes | None, width: int = 5, seed: int = 42) -> tuple[bytes, list[int]]:
    """The fingerprint of the set of a text's shingles, and its keys. Fewer words than a shingle
    are one shingle, and no words an empty one, so that all empty texts are alike."""
    words = (text or b"").lower().split()
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones, least = np.zeros(64 * WORDS, np.int64), np.full(KEYS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        h = hashes[at : at + 512, None]
        mixed = (h ^ (h >> np.uint64(31))) * _MIX[0] + _MIX[1]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed[:, WORDS:].min(axis=0))
        ones += np.unpackbits(np.ascontiguousarray(mixed[:, :WORDS]).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    keys = [xxhash.xxh64_intdigest(k.tobytes()) for k in least.reshape(KEYS, ROWS)]
    return np.packbits(2 * ones > len(hashes)).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


def link_radius(similarity: float, bits: int = 64 * WORDS, margin: float = 2.0) -> int:
    """The distance within which two texts of that Jaccard similarity are: the expected one (their
    shingle sets have a cosine of 2 s / (1 + s) at least), and ``margin`` standard deviations."""
    p = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi
    return int(bits * p + margin * np.sqrt(bits * p * (1 - p)))


def similar_links(sketches: DataFrame, radius: int, n_pivots: int = 16, bucket_rows: int = 4096) -> DataFrame:
    """(u, v) of sketches(node, fp, keys), of distinct nodes. Buckets of one row are left out before
    the fingerprints come in; larger ones keep their components whole."""
    rows = sketches.select("node", F.posexplode("keys").alias("t", "k"))
    sizes = written(rows.groupBy("t", "k").count().filter("count > 1"), "bucket-sizes")
    return linked(dealt(rows, sizes, bucket_rows, "inner").join(sketches.select("node", "fp"), "node"), radius, n_pivots)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, most_gone: int = 500_000) -> DataFrame:
    """One row of docs for each group of near copies, with all columns: of the smallest id, and of
    the smallest text hash where that id has several texts of the group.

    Texts are classes by their 64-bit hash, so exact copies cost one row; classes are linked at
    ``similarity`` or more of their sets of ``width``-word shingles, as far as fingerprints tell.
    Null and empty texts are near copies of each other. An id may have several texts: each is
    its own document. A null id comes after all others. Rows alike in id and text give one. An
    empty table gives no rows; extra columns stay, whatever their names. Long texts are used
    whole. What goes is filtered by broadcast up to ``most_gone`` rows, beyond it by a shuffle."""
    of = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    node, doc = "near_dedup node", "near_dedup id"
    marked = docs.withColumn(node, of).withColumn(doc, F.col(id_col))
    rows = written(marked.groupBy(F.col(node).alias("node"), F.col(doc).alias("doc")).agg(F.count("*").alias("n")), "near-dup-rows")
    schema = pa.schema([("node", pa.int64()), ("fp", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch) -> dict:
        found = [long_fingerprint(t, width) for t in utf8(batch.column(1))]
        return {"node": batch.column(0), "fp": [f for f, _ in found], "keys": [k for _, k in found]}

    texts = docs.select(of.alias("node"), F.col(text_col).cast("string").alias("text")).mapInArrow(by_batch(make, schema), "node long, fp binary, keys array<long>")
    sketches = written(texts.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "sketches")
    roots = components(similar_links(sketches, link_radius(similarity)))
    grouped = written(rows.join(roots.select(F.col("v").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "near-dup-groups")
    first = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "node")
    best = written(grouped.groupBy("root").agg(F.min(first).alias("best")), "near-dup-best")
    judged = grouped.join(best, "root").withColumn("best", (F.col("node") == F.col("best.node")) & F.col("doc").eqNullSafe(F.col("best.doc")))
    judged = written(judged.select("node", "doc", "n", "best").filter("not best or n > 1"), "near-dup-judged")
    how = "broadcast" if judged.count() <= most_gone else "merge"
    same = lambda other: (F.col(node) == other["node"]) & F.col(doc).eqNullSafe(other["doc"])
    gone, twice = judged.hint(how), judged.filter("best").hint(how)
    kept = marked.join(gone, same(gone), "left_anti")
    once = marked.join(twice, same(twice), "left_semi").dropDuplicates([node, doc])
    return kept.unionByName(once).drop(node, doc)
