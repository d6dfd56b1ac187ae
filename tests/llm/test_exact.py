"""Operators against brute force, round trips and held-out accuracy, on small tables that we make."""

import glob
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revstrata.llm import bpe, hnsw, kd_search, mixing, ngram_join, sharding, substring_dedup, token_counts, toxicity, warc_zst

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=None):
    rows = [(i, t, "en", source(i) if source else f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def awkward():
    """Null, empty, blank, tiny, very long, odd scripts, repeated."""
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) for _ in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "it's  don't\r\n\r\n漢字 ÄÖß × ÷ 😀  x" * 3), (6, long), (7, "same text here again"), (7, "same text here again"), (None, "no id at all")]


def hostile(spark):
    """Awkward texts with further columns whose names the operators use themselves."""
    df = docs_of(spark, awkward())
    return df.withColumns({c: F.lit(1) for c in ("bucket", "keys", "part", "uid", "ids", "names", "doc", "size", "shard", "order", "position", "root", "key", "__gone", "__doc", "__spans", "__id", "__position", "toxic", "tokens")})


# Search


def vectors(spark, n, d=12, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(2)
    x[n // 2] = x[0]  # a tie
    return x, spark.createDataFrame([(i, v.tolist(), 0, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, id int")


def brute(x, k, queries=None):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]] for i in (range(len(x)) if queries is None else queries)}


def found_by(df):
    got = {}
    for r in df.orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbor_id)
    return got


@pytest.mark.parametrize("shard_rows,step", [(10_000, 1), (60, 20)])
def test_knn(spark, shard_rows, step):
    x, df = vectors(spark, 400)
    got = found_by(kd_search.knn(df, 5, F.col("vec_id") % step == 0 if step > 1 else None, shard_rows=shard_rows))
    assert got == brute(x, 5, range(0, 400, step))


def test_knn_of_equal_vectors(spark):
    """A third of all vectors is one point, more than a shard has room for, and another third has two coordinates in common."""
    x = np.random.default_rng(3).normal(size=(300, 4)).round(1)
    x[::3] = [1.0, 2.0, 0.0, 0.0]
    x[1::3, :2] = 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(x, 5)
    assert found_by(kd_search.knn(df, 5, shard_rows=20)) == want
    got = found_by(hnsw.ann(df, 5, shard_rows=100))
    dist = lambda i, j: float(((x[i] - x[j]) ** 2).sum())
    assert sum(dist(i, a) == dist(i, b) for i in want for a, b in zip(got[i], want[i])) / (5 * len(x)) >= 0.9
    assert all(got[i] == want[i] for i in range(0, 300, 3))


def test_search_edges(spark):
    kind = "vec_id long, embedding array<double>, label int"
    inf = float("inf")
    rows = [(1, [0.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, [0.0, -0.0], 0), (3, [1.0, None], 0), (None, [1.0, 1.0], 0), (4, None, 0), (5, [], 0), (6, [1.0], 0), (7, [float("nan"), 0.0], 0), (8, [3.0, 4.0], 0), (9, [inf, 0.0], 0), (10, [0.0, -inf], 0)]
    for search in (kd_search.knn, hnsw.ann):
        got = {(r.vec_id, r.neighbor_id): (r.rank, r.distance) for r in search(spark.createDataFrame(rows, kind)).collect()}
        assert got == {(1, 2): (1, 0.0), (1, 8): (2, 5.0), (2, 1): (1, 0.0), (2, 8): (2, 5.0), (8, 1): (1, 5.0), (8, 2): (2, 5.0)}
        assert search(spark.createDataFrame([], kind)).count() == 0


def test_ann_recall(spark):
    x, df = vectors(spark, 1200, 24)
    got, want = found_by(hnsw.ann(df)), brute(x, 10)
    assert sum(len({*got[i]} & {*want[i]}) for i in want) / (10 * len(want)) >= 0.9


def test_ann_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found_by(hnsw.ann(df, 10, F.col("vec_id") % 20 == 0, shard_rows=700))
    want = found_by(kd_search.knn(df, 10, F.col("vec_id") % 20 == 0))
    assert len(want) >= 100 and set(got) == set(want)
    assert sum(len({*got[i]} & {*want[i]}) for i in want) / (10 * len(want)) >= 0.9


# BPE and token counts


def test_bpe(spark):
    df = hostile(spark)
    encoder = bpe.tokenizer()
    got = bpe.encode(df).collect()
    key = lambda p: (p[0] is None, p[0] or 0, str(p[1]))
    want = [(i, None if t is None else encoder.encode_ordinary(t)) for i, t in awkward()]
    assert sorted([(r.doc_id, r.ids) for r in got], key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(df)).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=key) == sorted(awkward(), key=key)
    assert bpe.encode(df.where("false")).count() == 0
    odd = spark.createDataFrame([([10**6, -1, None, 64],)], "ids array<int>")
    assert bpe.decode(odd).first().text == bpe.piece_table()[64].as_py().decode()


def test_token_counts(spark):
    df = hostile(spark)
    h = token_counts.length_histogram(df)
    n = [0 if t is None else len(bpe.tokenizer().encode_ordinary(t)) for _, t in awkward()]
    assert {r.n_tokens: r.n_docs for r in h.collect()} == Counter(n)
    for r in token_counts.limits(h).collect():
        assert r.tokens_kept == sum(min(x, r.context) for x in n) and r.docs_beyond == sum(x > r.context for x in n) and r.tokens_total == sum(n)
    a = token_counts.at_limit(h, 100).first()
    assert a.tokens_kept == sum(min(x, 100) for x in n)
    assert token_counts.quantile(h, 0.5).first().context == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.limits(token_counts.length_histogram(df.where("false"))).count() == 0


# Sharding


def test_schedule():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted((rng.choice([0, 1, 2, 3, 5, 8, 100]) for _ in range(rng.randrange(80))), reverse=True)
        shards = rng.randrange(1, 9)
        loads = [0] * shards
        for s in sizes:
            loads[loads.index(min(loads))] += s
        assert sharding.schedule(sorted(Counter(sizes).items(), reverse=True), shards)[1] == loads


def test_sharding_edges(spark):
    got = sharding.shard_documents(hostile(spark)).collect()
    assert len(got) == len(awkward()) and all(0 <= r.shard < sharding.SHARDS for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id in (1, 2)}) == 1
    assert sharding.shard_documents(hostile(spark).where("false")).count() == 0


# N-gram join


def grams(text, n=4):
    w = "".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_copies(rng, groups=12):
    texts = []
    for _ in range(groups):
        base = prose(rng, rng.choice([3, 12, 40, 300]))
        for _ in range(rng.randrange(1, 14)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append((len(texts), " ".join(w)))
    return texts


def roots_of(nodes, pairs):
    root = {i: i for i in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("block,heavy", [(4096, 4096), (7, 3)])
def test_ngram_join(spark, block, heavy):
    texts = near_copies(random.Random(4))
    sets = {i: grams(t) for i, t in texts}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    want = {k: v for k, v in want.items() if v >= 0.5}
    df = docs_of(spark, texts)
    root, links = roots_of(sets, want), Counter(i for p in want for i in p)
    got = ngram_join.ngram_links(df, block=block, heavy=heavy).collect()
    assert len(got) == len(links)
    assert {r.doc_id: (r.class_id, r.n_links, r.copy_id) for r in got} == {i: (root[i], n, min(j for j in sets if sets[j] == sets[i])) for i, n in links.items()}
    pairs, members = ngram_join.ngram_jaccard_join(df, block=block, heavy=heavy)
    score = {frozenset((r.class_a, r.class_b)): r.jaccard for r in pairs.collect()}
    assert len(score) == pairs.count()
    of = {r.doc_id: (r["class"], r.within) for r in members.collect()}
    found = {(i, j): of[i][1] if of[i][0] == of[j][0] else score.get(frozenset((of[i][0], of[j][0]))) for i in of for j in of if i < j}
    found = {k: v for k, v in found.items() if v is not None}
    assert set(found) == set(want) and all(abs(found[k] - want[k]) < 1e-12 for k in want)
    left = ngram_join.without_near_duplicates(df, block=block, heavy=heavy)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(root.values()))


def test_ngram_join_edges(spark):
    df = hostile(spark).unionByName(hostile(spark).where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long")))
    got = ngram_join.ngram_links(df).collect()
    assert [(r.doc_id, r.class_id, r.n_links, r.copy_id) for r in sorted(got)] == [(7, 7, 1, 7), (70, 7, 1, 7)]
    empty = hostile(spark).where("false")
    assert ngram_join.ngram_links(empty).count() == 0
    assert [x.count() for x in (*ngram_join.ngram_jaccard_join(empty), ngram_join.without_near_duplicates(empty))] == [0] * 3


# Substring dedup


def spans_by_hand(texts, length):
    seen, out = {}, []
    for i, t in sorted(texts):
        w = (t or "").split()
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first = seen.setdefault(key, (i, k))
            if first != (i, k):
                out.append((i, k, first[0]))
    merged = []
    for i, k, f in out:
        if merged and merged[-1][0] == i and merged[-1][3] == f and k <= merged[-1][2] + length:
            merged[-1][2] = k
        else:
            merged.append([i, k, k, f])
    return sorted((i, b - a + length, f) for i, a, b, f in merged)


@pytest.mark.parametrize("heavy", [4096, 2])
def test_substring_dedup(spark, heavy):
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (50, 51, 60, 75, 200)] + [["w1"] * 80, ["w1", "w2"] * 40]
    texts = []
    for i in range(60):
        w = prose(rng, rng.randrange(0, 40))
        for _ in range(rng.randrange(0, 3)):
            w += rng.choice(passages) + prose(rng, rng.randrange(0, 30))
        texts.append((i, "  ".join(w) + " "))
    df = docs_of(spark, texts)
    got = sorted((r.doc_id, r.n_words, r.first_doc_id) for r in substring_dedup.repeated_spans(df, heavy=heavy).collect())
    assert got == spans_by_hand(texts, 50)
    after = {r.doc_id: r for r in substring_dedup.without_repeats(df, heavy=heavy).collect()}
    assert len(after) == len(texts) and all(r.n_chars == len(r.text) for r in after.values())
    left = Counter(tuple(w[k : k + 200]) for r in after.values() for w in [r.text.split()] for k in range(len(w) - 199))
    assert all(v == 1 for v in left.values())


def test_substring_dedup_edges(spark):
    df = hostile(spark)
    out = substring_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert substring_dedup.without_repeats(df.where("false")).count() == 0


# Toxicity


def test_toxicity(spark):
    rng = random.Random(6)
    bad = [f"vile{i}" for i in range(12)]
    texts, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randrange(20, 80))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        texts.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    df = docs_of(spark, texts)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, known.where("doc_id < 400").unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (9999, 1, 1)], known.schema)))
    held = {r.doc_id: r.toxic for r in toxicity.classify(df, model).collect() if r.doc_id >= 400}
    assert sum(held[i] == bool(t) for i, _, t in labels[400:]) / len(held) >= 0.95
    assert toxicity.without_toxic(df, model).columns == df.columns
    odd = hostile(spark)
    assert toxicity.without_toxic(odd, model).count() == odd.count()
    none = toxicity.fit(df, known.where("toxic = 0"))
    assert not any(r.toxic for r in toxicity.classify(df, none).collect())
    assert toxicity.classify(df.where("false"), model).count() == 0


# WARC


def test_warc(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"http://x/{i}", " ".join(prose(rng, 50))) for i in range(300)] + [(300, None, ""), (301, "u", None), (None, "u", "z"), (5, "u", "again"), (302, "big", "é" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = str(tmp_path / "w")
    assert warc_zst.write(df, folder) == len(rows)
    got = warc_zst.read(spark, folder)
    assert got.where("error is not null").count() == 0
    key = lambda x: tuple((v is None, v or "" if isinstance(v, str) or v is None else v) for v in x)
    back = [(r.id, r.uri, bytes(r.payload).decode()) for r in got.select(F.expr("try_cast(substring_index(record_id, ':', -1) as bigint)").alias("id"), "uri", "payload").collect()]
    assert sorted(map(str, back)) == sorted(str((i, u, h or "")) for i, u, h in rows) and key
    head = open(sorted(glob.glob(folder + "/*.warc.zst"))[0], "rb").read(4)
    assert struct.unpack("<I", head)[0] == warc_zst.DICTIONARY_MAGIC


def test_warc_faults(spark, tmp_path):
    import zstandard

    z = zstandard.ZstdCompressor()
    good = warc_zst.record("response", "2024-01-01T00:00:00Z", b"abc", "urn:page:1")
    short = good.replace(b"Content-Length: 3", b"Content-Length: 9")
    long = good.replace(b"Content-Length: 3", b"Content-Length: 1")
    (tmp_path / "a.warc.zst").write_bytes(b"".join(map(z.compress, [good, short, long, good + good, good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good])) + b"junk that is no frame")
    (tmp_path / "b.warc.zst").write_bytes(b"")
    got = [(r.record, r.error) for r in warc_zst.read(spark, str(tmp_path)).orderBy("record").collect()]
    assert [n for n, _ in got] == list(range(8)) and got[0][1] is None and got[6][1] is None
    assert all(e for _, e in (got[1], got[2], got[3], got[4], got[5], got[7]))


# Mixing


def test_mixing(spark):
    rng = random.Random(8)
    df = docs_of(spark, [(i, " ".join(prose(rng, rng.randrange(0, 60)))) for i in range(500)], lambda i: "hot" if i % 5 else "small")
    got = mixing.curriculum(df).collect()
    total = sum(len(r.text.split()) for r in df.collect())
    assert [r.position for r in got] == sorted(r.position for r in got)
    supply = Counter()
    for r in df.collect():
        supply[r.source] += len(r.text.split())
    share = {s: n / total for s, n in supply.items()}
    root = {s: v**0.5 / sum(x**0.5 for x in share.values()) for s, v in share.items()}
    for t in (0.25, 0.5, 1.0):  # tokens taken by time t follow the integrated weights
        for s in share:
            want = total * (share[s] * t + (root[s] - share[s]) * t * t / 2)
            assert abs(sum(r.tokens for r in got if r.source == s and r.position < t) - want) <= 60
    out = mixing.mixed(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == list(range(500))


def test_mixing_edges(spark):
    df = hostile(spark).withColumn("source", F.when(F.col("doc_id") > 3, F.col("source")))
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert mixing.curriculum(df).count() >= df.count()
    assert mixing.curriculum(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0
    assert {r.position for r in mixing.curriculum(df.where("doc_id < 4")).collect()} == {0.0}
