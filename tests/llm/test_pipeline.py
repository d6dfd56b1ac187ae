"""The pipeline's stages one by one against brute force, and as a whole."""

import random

import corpus_pipeline
from tests.llm.test_exact import WORDS, grams, hostile, prose

from revstrata.llm import bpe


def tables(spark, path):
    rng = random.Random(11)
    passage, texts, labels = prose(rng, 60), [], []
    for i in range(300):
        w = prose(rng, rng.randrange(20, 90))
        toxic = i % 10 == 0
        if toxic:
            for k in range(5):
                w.insert(rng.randrange(len(w)), f"vile{k}{i % 7}")
        elif i % 10 == 1:
            w = texts[i - 10][1].split() if i > 10 else w
        elif i % 10 == 2:
            w = prose(rng, 120) + passage
        texts.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {t[0]: t[1] for t in texts}, passage


def test_run(spark, tmp_path):
    texts, passage = tables(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("position").collect()
    back = {r.doc_id: bpe.tokenizer().decode(r.ids) for r in got}
    assert all(i % 10 for i in back)  # toxic ones went
    clean = [i for i in texts if i % 10 > 2]
    assert set(clean) <= set(back) and all(back[i] == texts[i] for i in clean)
    copies = [i for i in texts if i % 10 == 1]
    assert [i for i in copies if i in back] == [1]
    with_passage = sorted(i for i in texts if i % 10 == 2)
    assert " ".join(passage) in back[with_passage[0]] and not any(" ".join(passage) in back[i] for i in with_passage[1:])
    assert [r.position for r in got] == sorted({r.position for r in got}) and all(r.n_tokens == len(r.ids) for r in got)
    assert len(grams(back[3])) and WORDS


def test_stages_keep_awkward_rows(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs, n = hostile(spark), hostile(spark).count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path + "-in")
        out = stage(spark, spark.read.parquet(path + "-in"), str(tmp_path))
        n -= name == "ngram_jaccard_join"  # of the row that comes twice one stays
        assert out.count() == n, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            docs = out
        none = stage(spark, spark.read.parquet(path + "-in").where("false"), str(tmp_path))
        assert none.count() == 0, name


def test_run_on_an_empty_table(spark, tmp_path):
    tables(spark, f"{tmp_path}/full")
    spark.read.parquet(f"{tmp_path}/full/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
