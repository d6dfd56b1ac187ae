"""Cases that a review found not covered."""

import random
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_exact import docs_of, prose

from revstrata.llm import _exchange, bpe, mixing, ngram_join, substring_dedup, toxicity, warc_zst


def test_bpe_parts_do_not_follow_batches(spark, tmp_path):
    """Batches that end at other rows when doc_id is read besides text, in one task of several parts."""
    path = str(tmp_path / "docs")
    text = F.concat_ws(" ", *[F.conv(F.pmod(F.col("id") * (2 * k + 3), F.lit(5003)), 10, 36) for k in range(15)])
    spark.range(0, 600_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(path)
    conf = {"spark.sql.execution.arrow.maxBytesPerBatch": "200000", "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.openCostInBytes": "1g", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() == 1
        wrong = bpe.decode(bpe.encode(docs), to="back").join(docs, "doc_id").where("text <> back or back is null")
        assert wrong.count() == 0 and bpe.encode(docs).count() == 600_000
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_bpe_check_follows_the_order_of_words():
    import numpy as np

    def check(texts):
        held = bpe.Words()
        for t in texts:
            held.add(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        return held.check()

    assert check([b"a b", b"c"]) == check([b"a b", b"c", b"a"]) != check([b"c", b"a b"])


def test_substring_dedup_of_texts_that_share_a_doc_id(spark):
    rng = random.Random(12)
    passage, other = prose(rng, 60), prose(rng, 70)
    a = " ".join(passage + prose(rng, 10))
    b = " ".join(passage + ["é" * 9] * 3 + prose(rng, 30) + other)
    c = " ".join(prose(rng, 7) + ["ü" * 40] + prose(rng, 30))
    df = docs_of(spark, [(7, a), (7, b), (7, c), (3, " ".join(other)), (7, a), (9, " ".join(prose(rng, 80)))])
    found = substring_dedup.repeated_spans(df)
    assert found.columns == ["doc_id", "start_byte", "end_byte", "n_words", "first_doc_id"]
    assert sorted((r.doc_id, r.n_words, r.first_doc_id) for r in found.collect()) == [(7, 60, 7), (7, 70, 3)]
    after = [r.text for r in substring_dedup.without_repeats(df).where("doc_id = 7").collect()]
    assert len(after) == 4 and c in after  # a text without repeats stays as it is
    texts = {" ".join(t.split()) for t in after}  # the repeated row is cut, or kept, alike
    assert len(texts) == 3 and sum(" ".join(passage) in t for t in texts) == 1 and not any(" ".join(other) in t for t in texts)
    cut_b = next(t for t in texts if "é" * 9 in t)
    assert cut_b in " ".join(b.replace(" ".join(passage), "").replace(" ".join(other), "").split()) or cut_b == " ".join(b.replace(" ".join(other), "").split())


def test_mixing_stage_takes_target_weights(spark):
    rng = random.Random(13)
    df = docs_of(spark, [(i, " ".join(prose(rng, rng.randrange(1, 60)))) for i in range(300)] + [(None, "no id")], lambda i: "hot" if i and i % 10 else "small")
    got = [r.doc_id for r in corpus_pipeline.in_training_order(spark, df, "", mixing.flattening).collect()]
    assert got.count(None) == 1
    want = mixing.curriculum(df.where("doc_id is not null")).collect()
    assert Counter(i for i in got if i is not None) == Counter(r.doc_id for r in want)
    used = Counter(got)
    assert max(used[i] for i in range(0, 300, 10)) > 1 and any(not used[i] for i in range(300) if i % 10)
    once = Counter(r.doc_id for r in corpus_pipeline.in_training_order(spark, df, "").collect())
    assert once == Counter([None, *range(300)])


def test_near_duplicates_of_texts_that_share_a_doc_id(spark):
    rng = random.Random(14)
    a, b, c = (" ".join(prose(rng, 60)) for _ in range(3))
    df = docs_of(spark, [(1, a), (2, a), (2, b), (3, c), (3, c), (4, c), (5, " "), (5, " "), (6, None)])
    left = sorted((r.doc_id, r.text) for r in ngram_join.without_near_duplicates(df).where("text is not null").collect())
    assert left == sorted([(1, a), (2, b), (3, c), (5, " "), (5, " ")])
    links = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_links(df).collect())
    assert links == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 3, 1)]


def test_windows_between_passages(spark):
    """Passages that share their inner words with others, windows of one word repeated, and texts with periods."""
    rng = random.Random(15)
    for words in (3, 20):
        vocabulary = [f"v{i}" for i in range(words)]
        some = [[rng.choice(vocabulary) for _ in range(rng.randrange(50, 90))] for _ in range(6)] + [["v0", "v1", "v2"] * 25, ["v0"] * 60]
        texts = [(i, " ".join([*prose(rng, rng.randrange(20)), *rng.choice(some)[rng.randrange(8) :], *prose(rng, rng.randrange(20)), *rng.choice(some)])) for i in range(80)]
        from tests.llm.test_exact import spans_by_hand

        got = sorted((r.doc_id, r.n_words, r.first_doc_id) for r in substring_dedup.repeated_spans(docs_of(spark, texts)).collect())
        assert got == spans_by_hand(texts, 50)


def test_bpe_of_rows_that_were_shuffled(spark):
    rng = random.Random(16)
    texts = [(i, " ".join(prose(rng, 30))) for i in range(500)]
    got = bpe.decode(bpe.encode(docs_of(spark, texts).repartition(5)), to="back").collect()
    assert sorted((r.doc_id, r.back) for r in got) == texts


def test_packed_keys():
    import numpy as np

    for n in (16, 1 << 10, 1 << 20):
        keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
        for b, i, j in _exchange.slices(_exchange.bucket_of(keys, n)):
            assert (_exchange.unpack_keys(_exchange.pack_keys(keys[i:j], n)) == _exchange.cut_keys(keys[i:j], n)).all() and 0 <= b < n


def test_buckets_have_no_end(monkeypatch):
    sizes = [10**9, 10**11, 10**12, 10**14, 10**16]
    at = iter(sizes)
    monkeypatch.setattr(_exchange, "plan_bytes", lambda df: next(at))
    counts = [_exchange.buckets(None) for _ in sizes]
    assert all(size / n <= 33e6 for size, n in zip(sizes, counts)) and counts == sorted(counts)


def test_components(spark):
    rng = random.Random(17)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + k, 401 + k) for k in range(40)] + [(900, 1000 + k) for k in range(50)]
    from tests.llm.test_exact import roots_of

    want = {i: r for i, r in roots_of({x for e in edges for x in e}, edges).items() if i != r}
    for per_task in (2_000_000, 60):
        got = _exchange.components(spark.createDataFrame(edges, "u long, v long"), per_task).collect()
        assert {r.node: r.root for r in got} == want and len(got) == len(want)


def test_mixed_is_in_the_order_of_positions(spark):
    rng = random.Random(18)
    df = docs_of(spark, [(i, " ".join(prose(rng, rng.randrange(1, 40)))) for i in range(200)] + [(7, "another text of the same id")], lambda i: f"s{i % 3}")
    known = mixing._counted(df).groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")
    stats = known.groupBy("source").agg(F.sum("tokens").alias("supply"), F.avg("tokens").alias("mean"))
    at = {r.doc_id: r.position for r in mixing.positions(known, mixing.tilted(stats, F.col("mean") / (F.col("mean") + 500.0))).collect()}
    got = [r.doc_id for r in mixing.mixed(df).collect()]
    assert got == sorted(got, key=lambda i: (at[i], i)) and Counter(got) == Counter([*range(200), 7])


def test_labels_that_are_not_used(spark):
    rng = random.Random(19)
    texts = [(i, " ".join(prose(rng, 20) + (["vile1", "vile2"] if i % 3 == 0 else []))) for i in range(150)]
    df, kind = docs_of(spark, texts), "doc_id long, toxic int"
    good = [(i, int(i % 3 == 0)) for i in range(150)]
    odd = [(1, 2), (2, -1), (None, 1), (4, None)] + [(10_000 + i, i % 2) for i in range(300)]
    a, b = (toxicity.fit(df, spark.createDataFrame(x, kind), most=160) for x in (good, good + odd))
    assert (a.kept == b.kept).all() and (a.weight == b.weight).all() and len(a.kept)


def test_toxicity_against_a_fit_by_hand(spark):
    """Features, log-count ratios and the regression, with n-grams as strings."""
    import numpy as np

    rng = random.Random(20)
    texts = [(i, " ".join(prose(rng, 12) + ([rng.choice(["Vile", "vilé"])] if i % 2 else []))) for i in range(80)]
    y = np.array([i % 2 for i, _ in texts])
    model = toxicity.fit(docs_of(spark, texts), spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, toxic int"))
    lower = [("".join(c.lower() if c.isascii() else c for c in t)) for _, t in texts]
    has = [{t[k : k + n] for n in (3, 4, 5) for k in range(len(t) - n + 1)} for t in lower]
    names = sorted(set().union(*has))
    x = np.array([[g in h for g in names] for h in has], float)
    one, zero = x[y == 1].sum(0), x[y == 0].sum(0)
    ratio = np.log((one + 0.5) / ((y == 1).sum() + 1)) - np.log((zero + 0.5) / ((y == 0).sum() + 1))
    expected = (one + zero) * y.mean()
    kept = (one - expected) ** 2 / np.maximum(expected, 0.5) > toxicity.LEAST
    assert abs(int(kept.sum()) - len(model.kept)) <= 2  # two n-grams may share a place in the table
    z, w, bias = x[:, kept] * ratio[kept], np.zeros(int(kept.sum())), 0.0
    for _ in range(3000):
        err = (1 / (1 + np.exp(-(z @ w + bias))) - y) / len(y)
        w, bias = w - 0.05 * (z.T @ err + 1e-4 * w), bias - 0.05 * err.sum()
    by_hand = (z @ w + bias) > 0
    got = {r.doc_id: r.toxic for r in toxicity.classify(docs_of(spark, texts), model).collect()}
    assert [got[i] for i, _ in texts] == by_hand.tolist() == [bool(v) for v in y]


def test_warc_dictionary_limit_and_line_ends(spark, tmp_path):
    import struct

    import zstandard

    z = zstandard.ZstdCompressor()
    ok = [warc_zst.record("response", "2024-01-01T00:00:00Z", b"x" * n, f"urn:page:{n}") for n in (3, 5000, 4)]
    frames = b"".join(map(z.compress, ok))
    bad = struct.pack("<II", warc_zst.DICTIONARY_MAGIC, 8) + struct.pack("<I", 0xFD2FB528) + b"junk"
    (tmp_path / "a.warc.zst").write_bytes(bad + frames)
    (tmp_path / "b.warc.zst").write_bytes(frames)
    got = {}
    for r in warc_zst.read(spark, str(tmp_path), most_record=2000).orderBy("record").collect():
        got.setdefault(r.file[-10], []).append((r.error, len(r.payload)))
    assert len(got["a"]) == 1 and "dictionary" in got["a"][0][0]
    assert got["b"] == [(None, 3), ("larger than the limit for a record", 0), (None, 4)]
    folder = str(tmp_path / "w")
    warc_zst.write(spark.createDataFrame([(1, "http://a/\r\nX: y\n", "t")], "page_id long, url string, html string"), folder)
    assert [(r.uri, r.error) for r in warc_zst.read(spark, folder).collect()] == [("http://a/%0D%0AX: y%0A", None)]
