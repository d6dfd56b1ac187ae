"""What the findings of reviews were about, on small inputs that show it."""

import random
import re

import duckdb
import pytest

from revstrata.plans import catalog

WORDS = "the a of one two three Four FIVE é 漢字 x-y".split()


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A folder with 63 documents: the last page has three, long before the end of the others; texts of many lines, empty, null, in
    odd white space, one of them no separator."""
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", "\t ", " ", "\n\n "]).join(rng.choice(WORDS) for _ in range(rng.choice([4, 30, 31, 300]))) for _ in range(63)]
    texts[4], texts[9], texts[22], texts[23] = None, "", " \n ", texts[21]
    path = str(tmp_path_factory.mktemp("documents"))
    rows = [(i, t, "en", None if i % 5 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def by_sql(path: str, name: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/documents.parquet/*.parquet')")
    con.execute(f"create view result as {catalog.SQL[name]}")
    columns = ", ".join(f'"{c}"' for c in sorted(r[0] for r in con.execute("describe result").fetchall()))
    return sorted(map(repr, con.execute(f"select {columns} from result").fetchall()))


def by_spark(spark, path: str, name: str) -> list[tuple]:
    df = catalog.QUERIES[name](spark, path)
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_last_bases_of_pages_that_ended_early(spark, documents):
    """stream_adaptive: the page of three documents is over 30 days before the end, but its last base isn't returned."""
    assert by_spark(spark, documents, "stream_adaptive") == by_sql(documents, "stream_adaptive")


@pytest.fixture(scope="module")
def repeated(spark, documents, tmp_path_factory):
    """The documents, some of them three times, and two whose id is null."""
    path = str(tmp_path_factory.mktemp("repeated"))
    d = spark.read.parquet(f"{documents}/documents.parquet")
    again = d.where("doc_id in (7, 22, 40)")
    none = d.where("doc_id in (3, 11)").selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    d.unionByName(again).unionByName(again).unionByName(none).coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["temporal_inverted_index", "tf_postings", "sampled_words"])
def test_words_are_counted_in_a_stream(spark, documents, repeated, name):
    """Rows of single words are neither sorted nor exchanged: what a task holds are sorted texts."""
    plan = catalog.QUERIES[name](spark, documents)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Window" not in plan
    assert by_spark(spark, documents, name) == by_sql(documents, name)
    if name == "tf_postings":  # for the others SQL leaves open which of a revision's rows comes first
        assert by_spark(spark, repeated, name) == by_sql(repeated, name)


def test_additions_of_repeated_revisions():
    from revstrata.operators import words

    rows = [(1, 10, 5, b"a a b"), (1, 20, 6, b"a"), (1, 20, 6, b"c a"), (1, 20, 6, b"c"), (1, 30, 7, b"a c c c"), (1, 40, 8, b""), (1, 50, 9, b"c"), (2, 10, 1, b"c\x0bc\x1cd")]
    rows = [(None, None, None, b"a"), (None, None, None, b"a b"), *rows]
    got = [(key, {w: n - old.get(w, 0) for w, n in c.items() if n > old.get(w, 0)}) for key, c, old in words.additions(rows)]
    assert got.pop(0) == ((None, None, None, -1), {b"a": 2, b"b": 1})
    assert got == [((1, 5, 10, -1), {b"a": 2, b"b": 1}), ((1, 6, 20, 10), {}), ((1, 6, 20, 20), {b"c": 2}), ((1, 7, 30, 20), {b"c": 1}), ((1, 9, 50, 40), {b"c": 1}), ((2, 1, 10, -1), {b"c": 1, b"c\x1cd": 1})]


def test_few_rows_are_python_objects_at_a_time():
    """The Arrow functions of revision_diff, revision_patch, concat_text and annotate take slices of a batch, wide rows alone."""
    import pyarrow as pa

    from revstrata.functions.arrow import slices

    words = pa.array([["word"] * (2000 if i == 17 else 50) for i in range(5000)])
    parts = list(slices((words, pa.array(["x" * 90] * 5000)), 10_000))
    assert all(len(a) == 1 or a.nbytes + b.nbytes <= 10_000 for a, b in parts) and len(parts) > 100
    assert [x for a, _ in parts for x in a.to_pylist()] == words.to_pylist()
    assert [len(a) for a, _ in slices((words[:0], words[:0]))] == [0]


@pytest.mark.parametrize("name", ["revision_diff", "revision_patch", "concat_text", "added_links", "annotate", "clean_markup", "plain_text", "links_context"])
def test_text_functions_take_slices(spark, documents, name):
    """Functions of rows see no whole batch: they are Arrow iterators (251), not pandas functions of a batch (200)."""
    plan = catalog.QUERIES[name](spark, documents)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"ArrowEvalPython .*\], (\d+)", plan)) == {"251"}


def test_patches_are_made_beside_their_diffs(spark, documents):
    """revision_patch: a task has one Python worker, deltas aren't sent back and forth, and the rows are those of both functions."""
    from revstrata.functions.diff import diff, patched, rebuilt

    plan = catalog.QUERIES["revision_patch"](spark, documents)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython ", plan.partition("Initial Plan")[0])) == 1
    assert by_spark(spark, documents, "revision_patch") == by_sql(documents, "revision_patch")
    cases = [(None, ["a"]), (["a"], None), (None, None), ([], []), (["a", "b", "c"], ["b", "x", "c", "d"]), (["a", "a"], ["a"]), (["b"], ["b"])]
    df = spark.createDataFrame(cases, "old array<string>, new array<string>")
    rows = df.select("new", rebuilt("old", "new").alias("one"), patched("old", diff("old", "new")).alias("two")).collect()
    assert all(r.one == r.two == (r.new or []) for r in rows) and len(rows) == len(cases)


@pytest.mark.parametrize("name", ["revision_diff", "added_links", "concat_text"])
def test_diffs_are_made_once(spark, documents, name):
    """One Python worker a task: the plan has no second diff, as a filter before an explode would."""
    plan = catalog.QUERIES[name](spark, documents)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython ", plan.partition("Initial Plan")[0])) == 1
    if name == "added_links":
        assert by_spark(spark, documents, name) == by_sql(documents, name)
