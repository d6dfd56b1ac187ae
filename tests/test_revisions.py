"""Readers, sequences, diffs and markup on a miniature dump of our own."""

import bz2
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from revstrata.functions import diff, markup, sql, strings, titles
from revstrata.functions.links import graph_key, link_contexts, links, templates
from revstrata.operators import filters, sequence
from revstrata.sources import records, revisions, sinks

DUMP = """<mediawiki><siteinfo><sitename>x</sitename></siteinfo>
<page><title>Old name</title><ns>0</ns><id>7</id><redirect title="New name" />
 <revision><id>70</id><timestamp>2012-01-31T23:30:00Z</timestamp><contributor><username>Ann</username><id>3</id></contributor><comment>a &amp; b</comment><text xml:space="preserve">#REDIRECT [[New name]]</text></revision>
</page>
<page><title>Talk:Thing</title><ns>1</ns><id>8</id>
 <revision><id>80</id><timestamp>2012-02-01T00:10:00Z</timestamp><contributor><ip>10.0.0.1</ip></contributor><text xml:space="preserve" /></revision>
 <revision><id>81</id><parentid>80</parentid><timestamp>2012-02-01T00:50:00Z</timestamp><contributor><username>Bo</username><id>4</id></contributor><minor /><text xml:space="preserve">first line here
second</text></revision>
 <revision><id>82</id><parentid>79</parentid><timestamp>2012-02-09T00:50:00Z</timestamp><contributor><username>Bo</username><id>4</id></contributor><text xml:space="preserve">first line here
changed
third</text></revision>
</page></mediawiki>"""


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    p = tmp_path_factory.mktemp("dump")
    (p / "d.xml.bz2").write_bytes(bz2.compress(DUMP.encode()))
    return str(p / "d.xml.bz2")


def test_xml(spark, dump):
    r = {x.rev_id: x for x in revisions.read_xml(spark, dump).collect()}
    assert sorted(r) == [70, 80, 81, 82]
    assert (r[70].user, r[70].user_id, r[70].comment, r[70].redirect) == ("Ann", 3, "a & b", "New name")
    assert (r[80].user, r[80].user_id, r[80].ip, r[80].text, r[80].length, r[80].parent_id) == (None, -1, "10.0.0.1", "", 0, 0)
    assert r[81].minor and not r[82].minor and r[82].parent_id == 79
    assert [x.rev_id for x in revisions.read_xml(spark, dump, only_articles=True).collect()] == [70]
    assert revisions.read_xml(spark, dump, only_articles=True, skip_redirects=True).count() == 0
    assert {x.rev_id for x in revisions.read_xml(spark, dump, begin="2012-02-01T00:50:00Z", end="2012-02-09T00:50:00Z").collect()} == {81}
    page = {x.page_id: x for x in revisions.current_pages(spark, dump).collect()}
    assert page[7].is_redirect and page[8].text.endswith("third") and not page[8].is_article


def test_pairs_and_buckets(spark, dump):
    r = revisions.read_xml(spark, dump)
    assert {x.rev_id: x.prev_rev_id for x in sequence.pairs(r).collect()} == {70: -1, 80: -1, 81: 80, 82: 81}
    assert {x.rev_id for x in sequence.last_per_bucket(r, "hour").collect()} == {70, 81, 82}
    assert {x.rev_id for x in sequence.last_per_bucket(r, "month").collect()} == {70, 82}
    assert {x.rev_id: x.prev_rev_id for x in sequence.bucket_pairs(r, "day").collect()} == {70: -1, 81: -1, 82: 81}


def test_diffs(spark, dump):
    d = {x.rev_id: x.deltas for x in sequence.revision_diffs(revisions.read_xml(spark, dump)).collect()}
    assert [(x.op, x.orig, x.rev) for x in d[82]] == [("CHANGE", ["second"], ["changed", "third"])]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        assert diff.patch(a, diff.deltas(a, b)) == b


def by_hand(lengths: list[int], minor: set[int]) -> list[int]:
    base, out = None, []
    for i, n in enumerate(lengths):
        if n < 10:
            continue
        if base is not None:
            score = 0.0005 if i in minor else abs(n - lengths[base]) / lengths[base]
            if 0.01 <= score <= 0.1:
                continue
            if score > 0.1:
                out.append(base)
        base = i
    return out + ([] if base is None else [base])


def test_adaptive_sample(spark):
    rng = random.Random(2)
    pages = {p: [rng.choice([3, 100, 101, 105, 109, 120, 200, 202]) for _ in range(rng.randrange(1, 30))] for p in range(20)}
    pages[99], pages[100] = [100, 100, 105, 200, 201], [100, 200, 400]
    minor = {p: {i for i in range(len(x)) if rng.random() < 0.2} for p, x in pages.items()} | {100: {1}}
    df = spark.createDataFrame([(p, i, 1000 * i, n, i in minor[p] or None) for p, x in pages.items() for i, n in enumerate(x)], "page_id long, rev_id long, ts_ms long, length long, minor boolean")
    got = sequence.adaptive_sample(df).collect()
    for p, x in pages.items():
        assert sorted(g.rev_id for g in got if g.page_id == p) == by_hand(x, minor[p])
    assert by_hand(pages[100], {1}) == [1, 2]
    steps = {r.rev_id: (r.last_rev_id, r.last_ts) for r in sequence.adaptive_steps(df.where("page_id = 99")).collect()}
    assert steps == {1: (-1, 0), 4: (1, 1000)}
    every = sequence.adaptive_steps(df.where("page_id = 99"), score=lambda now, base, last: 1.0).collect()
    assert sorted(r.rev_id for r in every) == [0, 1, 2, 3, 4]
    assert sequence.adaptive_sample(df.where("false")).count() == 0


def test_change_score(spark):
    df = spark.createDataFrame([(5, 0, True), (5, None, True), (5, 10, True), (5, 10, False)], "n int, before int, minor boolean")
    assert [r.s for r in df.select(strings.change_score(F.col("n"), F.col("before"), F.col("minor")).alias("s")).collect()] == [1.0, 1.0, 0.0005, 0.5]


def test_headers_without_texts(spark, dump, tmp_path):
    h = {r.rev_id: r for r in revisions.read_xml_headers(spark, dump).collect()}
    full = {r.rev_id: r for r in revisions.read_xml(spark, dump).collect()}
    assert set(h) == set(full) and all(h[i][c] == full[i][c] for i in h for c in ("page_id", "parent_id", "ts_ms", "minor", "page_title"))
    (tmp_path / "r.json").write_text('{"page_id": 1, "page_title": "t", "page_namespace": 0, "rev_id": 2, "parent_id": 0, "timestamp": 5, "user": "u", "user_id": 1, "comment": "", "text": "x"}\n')
    assert [(r.rev_id, r.ts_ms) for r in revisions.read_json_headers(spark, str(tmp_path)).collect()] == [(2, 5)]


def test_markup_is_linear():
    import time

    took = []
    for n in (4000, 32_000):
        begin = time.perf_counter()
        markup.clean("<ref>x " * n), markup.plain("<ref>x " * n), markup.annotations("<ref>x " * n)
        took.append(time.perf_counter() - begin)
    assert took[1] < 24 * took[0] + 0.5
    assert markup.drop_elements("a<ref>b</ref>c<REF n=1>d</ref >e<ref>f", ["ref"]) == "ace<ref>f"
    assert markup.drop_elements("</ref>a<b><ref>x<b>y</ref></b>", ["ref", "b"]) == "</ref>a"


def test_as_of(spark):
    revs = spark.createDataFrame([(1, 10, 100), (1, 11, 200), (2, 12, 50)], "page_id long, rev_id long, ts_ms long")
    points = spark.createDataFrame([(1, 99), (1, 100), (1, 150), (1, 900), (3, 1)], "page_id long, at_ms long")
    assert {(x.page_id, x.at_ms): x.rev_id for x in sequence.in_effect(points, revs).collect()} == {(1, 99): None, (1, 100): 10, (1, 150): 10, (1, 900): 11, (3, 1): None}


def test_json_lines(spark, tmp_path):
    good = {"page_id": 1, "page_title": "t", "page_namespace": 0, "rev_id": 2, "parent_id": 0, "timestamp": 5, "user": "u", "user_id": 1, "comment": "", "text": "äb"}
    lines = [json.dumps(good), json.dumps(good | {"page_namespace": 4}), json.dumps({k: v for k, v in good.items() if k != "text"}), "{broken"]
    (tmp_path / "r.json").write_text("\n".join(lines))
    assert [(x.rev_id, x.length) for x in revisions.read_json(spark, str(tmp_path)).collect()] == [(2, 3)]
    assert revisions.read_json(spark, str(tmp_path), only_articles=False).count() == 2


def test_logs_and_archives(spark, tmp_path):
    lines = ['1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326', '1.2.3.4 - - [bad] "-" 404 -', "no log"]
    got = records.parse_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(x.user_id, x.epoch_ms, x.method, x.resource, x.size) for x in got] == [("bob", 971211336000, "GET", "/a", 2326), (None, None, None, None, None)]
    raw = b"WARC/0.18\nWARC-Type: response\nWARC-TREC-ID: d-1\nContent-Length: 9\n\nWARC/0 xx\n\nWARC/0.18\nWARC-Type: info\nContent-Length: 0\n\n"
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(raw) + gzip.compress(raw.replace(b"d-1", b"d-2")))
    assert sorted((x.doc_id, x.headers["WARC-Type"]) for x in records.read_archive_headers(spark, str(tmp_path)).collect()) == [("d-1", "response"), ("d-1", "response"), ("d-2", "response")]
    assert records.file_names(spark, str(tmp_path)).count() == 2


def test_tsv_text_and_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", [1, 2]), (2, None, [])], "page_id long, title string, n array<int>")
    sinks.write_text(df, f"{tmp_path}/t", ["title"])
    assert sorted(x.value for x in spark.read.text(f"{tmp_path}/t").collect()) == sorted(["a b\t1\t1 2", "2\t"])
    sinks.write_tsv(df.select("page_id", "title"), f"{tmp_path}/v", "bzip2")
    assert records.read_id_map(spark, f"{tmp_path}/v").where("title = 'a b'").count() == 1
    sinks.write_documents(df.where("page_id = 1").withColumn("text", F.lit("body")), f"{tmp_path}/d", "http://x")
    assert [x.value for x in spark.read.text(f"{tmp_path}/d").collect()] == ['<doc id="1" url="http://x?curid=1" title="a b">', "body", "</doc>"]
    (tmp_path / "s.txt").write_text("A 2013-01 6 1 2 3\n")
    assert records.read_series(spark, f"{tmp_path}/s.txt").first().series == [1, 2, 3]


def test_links(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string")
    text = "x [[A b|c]] [[D#e]] [[File:f|g]] [[]] [[#h]] [[i|j|k]]\n[[open"
    assert [(x.anchor, x.target) for x in one(text).select(links(F.col("t")).alias("l")).first().l] == [("c", "A b"), ("D", "D"), ("j|k", "i")]
    got = one(text).select(link_contexts("t").alias("l")).first().l
    assert [(x.target, x.offset) for x in got] == [("A b", 4), ("D", 14), ("i", text.index("i|j"))] and got[0].pre == "x " and text[got[2].offset] == "i"
    assert one("{{a}} {{b|c}} {{x icon}} {{Good article}} {{n:s}} {{d#e}}").select(templates(F.col("t")).alias("l")).first().l == ["a", "d"]
    assert one("a c-漢").select(graph_key(F.col("t")).alias("k")).first().k == "a$0020c-$6F22"
    assert one("a").select(graph_key(F.col("t")).alias("k")).first().k == "WTF"


def test_titles(spark):
    cases = {"a  b": "A_b", "''''''": "", "'''": "", "\"": "", "'''a''": "'a", " x\t\ny ": "X_y", "_a b#c": "A_b", "'''q'''": "Q", "\"q\"": "Q", "wiki/x": "X", "#x_": "X", "a&b": "A", "Éa": "Éa", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {x.t: x.n for x in df.select("t", titles.normalised(F.col("t")).alias("n")).collect()} == cases
    df = spark.createDataFrame([("Talk:x",), ("x.jpg",), ("a/Talk:b",), ("Plain",), ("http://a",)], "t string")
    assert [x.t for x in df.where(titles.is_article(F.col("t"))).collect()] == ["Plain"]
    df = spark.createDataFrame([("AB2C?,CX10",)], "t string").select(titles.day_segments(F.col("t")).alias("s"))
    assert [(x.day, x.hours) for x in df.first().s] == [(1, "B2C?"), (3, "X10")]


def test_strings(spark):
    df = spark.createDataFrame([("http://a.b.co.uk/x",), ("https://u:p@www.x.org:80",), ("nothing",)], "u string")
    assert [x.d for x in df.select(strings.domain(F.col("u")).alias("d")).collect()] == ["b.co.uk\tco.uk", "x.org\torg", None]
    assert spark.createDataFrame([("The cat, the Hat",)], "t string").select(strings.tokens(F.col("t"), "stop").alias("w")).first().w == ["cat", "hat"]
    assert spark.createDataFrame([("ab",)], "t string").select(strings.cut_last(F.col("t"), 5).alias("w")).first().w == ""


def test_markup(spark):
    t = "{{a {{b}} c}}'''Bold''' [[X|y]]s [[File:z]] <!-- no --><ref>r</ref>\n{| t |}\n== H ==\n* item [http://u v]\n== Empty ==\n"
    assert markup.drop_nested("a{{b{{c}}d}}e{{f", "{{", "}}") == "ae{{f"
    assert "Bold ys" in markup.clean(t) and "ref" not in markup.clean(t) and "[[X|ys]]" in markup.clean(t, True)
    assert markup.compact(markup.clean(t)) == ["Bold ys", "H.", "item v"]
    a = markup.annotations(t)
    assert [a["text"][x["begin"] : x["end"]] for x in a["links"]] == ["y"] and [x["value"] for x in a["headers"]] == ["H", "Empty"]
    assert markup.redirect_target("#WEITERLEITUNG [[Ziel#x]]", "de") == "Ziel" and markup.redirect_target("text") is None
    assert markup.normal_title(" talk:_foo  bar") == "Talk:Foo bar"
    sql.register(spark)
    row = spark.sql("select clean_markup('[[a|b]]') c, next_day_of('20111231') d, day_of_millis(1293840001000) e, annotated('x [[y]]').text t").first()
    assert (row.c, row.d, row.e, row.t) == ("b", "20120101", "20110101", "x y")


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 10)], "page_id long, redirect string, ts_ms long")
    assert filters.without_redirects(df).count() == 1 and filters.complete(df).count() == 1
    assert filters.time_window(df, 5, 10).count() == 1 and filters.strict_window(df, 5, 11).count() == 1
