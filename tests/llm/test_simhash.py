import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from threadline.llm import simhash as S


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    low = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [low.get(find(i)) for i in range(len(fps))]


def chain(n=60, seed=1):
    """Fingerprints in clusters, chains and alone."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        fp = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 6, 12])):
            out.append(fp)
            for _ in range(r.randint(0, 5)):
                fp ^= 1 << r.randrange(64)
    return out


@pytest.mark.parametrize("bucket_rows", [4096, 3])
def test_links_keep_components(spark, bucket_rows):
    fps = chain()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in sorted(set(signed))], "fp long")
    links = S.near_links(classes, bucket_rows=bucket_rows)
    roots = {r.v: r.root for r in S.components(links).collect()}
    got = [roots.get(f, f) for f in signed]
    want = plain_components(list(range(len(fps))), fps)
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_pivots_never_discard_a_link():
    fps = np.array(chain(), np.uint64)
    dist = S.distance_table(fps, S.pivots(16)).astype(int)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    assert (np.abs(dist[:, None] - dist[None, :]).max(axis=2)[near] <= 4).all()


def test_against_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs).collect()} == want


def test_awkward_rows(spark, awkward, nothing):
    rows = S.simhash_components(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].component_id for i in (1, 2, 3, 4, 6)] == [1, 1, 3, 3, 3]
    assert by_id[4].fingerprint == "0" * 16
    assert by_id[None].component_id is None
    assert sum(r.doc_id == 2 for r in rows) == 2
    kept = S.near_dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5, 7, 8]
    assert S.simhash_components(nothing).count() == S.near_dedup(nothing).count() == 0


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def check_near_dedup(before, kept):
    """before, kept: texts by id. No two kept texts are alike, and what went is like another text."""
    likeness = lambda a, b: len(a & b) / len(a | b)
    sets = {i: shingles(t) for i, t in before.items()}
    left = sorted(kept)
    assert not [(i, j) for n, i in enumerate(left) for j in left[:n] if sets[i] & sets[j] and likeness(sets[i], sets[j]) >= 0.8]
    for i in set(before) - set(kept):
        assert max(likeness(sets[i], s) for j, s in sets.items() if j != i) > 0.7
    return len(left)


def test_near_dedup_against_shingles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 1 < check_near_dedup(texts, [r.doc_id for r in S.near_dedup(docs).collect()]) < len(texts)


def test_recall_by_similarity():
    r = random.Random(5)
    found = {}
    for _ in range(150):
        words = [str(r.getrandbits(20)) for _ in range(r.choice([60, 200, 700]))]
        other = list(words)
        for _ in range(r.randint(0, len(words) // 30)):
            other[r.randrange(len(words))] = str(r.getrandbits(20))
        a, b = (" ".join(w) for w in (words, other))
        (f, k), (g, m) = (S.long_fingerprint(t.encode()) for t in (a, b))
        likeness = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        distance = int(np.bitwise_count(np.frombuffer(f, "<u8") ^ np.frombuffer(g, "<u8")).sum())
        found.setdefault(likeness >= 0.8, []).append((distance <= S.link_radius(0.8) and any(x == y for x, y in zip(k, m, strict=True)), likeness))
    assert np.mean([x for x, _ in found[True]]) >= 0.95
    assert not any(x for x, likeness in found[False] if likeness < 0.7)


@pytest.mark.parametrize("most_gone", [500_000, 0])
def test_ids_with_several_texts(spark, most_gone):
    rows = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "totally other words stand here alone"), (None, "x y z"), (None, "x y z"), (None, "p q r"), (7, None), (8, ""), (7, None), (9, "p q r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("n", F.lit("n")).withColumn("best", F.lit(2))
    kept = S.near_dedup(docs, most_gone=most_gone)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.fillna("", ["text"]).collect())
    assert got == [(0, "x y z"), (1, "a b c d e f"), (5, "totally other words stand here alone"), (7, ""), (9, "p q r")]


def test_many_copies_in_few_chunks(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], f"new{i}", *words[i + 1 :]])) for i in range(60)] + [(1000 + i, f"quite different text number {i} of {i * 7} words") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketches = docs.select(F.col("doc_id").alias("node"), F.col("text"))
    found = {r.node: S.long_fingerprint(r.text.encode()) for r in sketches.collect()}
    made = spark.createDataFrame([(i, bytearray(f), k) for i, (f, k) in found.items()], "node long, fp binary, keys array<long>")
    roots = {r.v: r.root for r in S.components(S.similar_links(made, S.link_radius(0.8), bucket_rows=7)).collect()}
    assert [roots.get(i, i) for i in range(60)] == [0] * 60 and not set(roots) & set(range(1000, 1005))


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "z y x w v u")], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.near_dedup(docs).collect()) == [1, 2]


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in S.components(links).collect()} == {0}
    assert S.components(links.filter(F.lit(False))).count() == 0
