"""Every operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from vectrail.llm import ann_tree, hash_tree, html_extract, near_dup, packing, piece_codec, quality_qda, quality_rules, secret_ledger, url_cascade

#: Names that the operators use inside.
CLASHES = "__h __b __clean __lang __source __cut __l __s __rules __blob __doc __x __id __y __gone __gone_h row text2 lang2 h_blob found clean g_id g_h o_id num copies grp tie bin_id kept uses asks node near root".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, bucket int, id string, h string, size int, key string, blob string, rule string, cut string, b string, n int, doc string, x string, " + ", ".join(f"`{c}` string" for c in CLASHES)
SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


def _rows():
    base = " ".join(f"word{i} of the text" for i in range(60))
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, base.replace("word7 ", "other "), "en", None),
        (4, None, "en", "a"),
        (5, "", None, "a"),
        (6, " \n\t ", "en", "a"),
        (None, "short one", None, None),
        (7, "x", "en", "a"),
        (8, " ".join(f"w{i * i}" for i in range(30_000)), "en", "a"),
        (9, "y" * 200_000, "en", "a"),
        (10, f"see {SECRET} and {SECRET} here", "de", "b"),
        (10, f"see {SECRET} and more", "de", "b"),
        (11, "a b \U0001f600 ▁ é  ", "de", "b"),
    ]
    return [(i, t, la, s, None if t is None else len(t), *["clash", 1, "clash", "clash", 1, "clash", "clash", "clash", "clash", "clash", 1, "clash", "clash", *CLASHES]) for i, t, la, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), DOCS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 1, 0), (9, 0, 0), (7, 0, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int")


def _ids(df, column="doc_id"):
    return sorted((r[column] for r in df.select(column).collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 11, None]


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t"), (None, "<p>a", "t"), (3, "<b>" * 5000 + "deep", "t"), (4, "<table><tr><td>1<td>2", "t")], "page_id bigint, html string, text string")
    got = {(r.page_id, r.text) for r in html_extract.extract(pages).collect()}
    assert got == {(1, None), (2, ""), (None, "a"), (3, "deep"), (4, "1 | 2")}
    long = "<p>word </p>" * 200_000
    assert html_extract.render(long).count("word") == 200_000
    assert html_extract.extract(pages).count() == 6
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_packing(docs, nothing):
    rows = packing.pack(docs, capacity=1000).collect()
    assert sum(r.n_words for r in rows if r.doc_id == 8) == 30_000
    assert len([r for r in rows if r.doc_id == 2]) == 2
    assert {r.doc_id for r in rows} == {1, 2, 3, 7, 8, 9, 10, 11, None}
    fill = {}
    for r in rows:
        fill[r.bin_id] = fill.get(r.bin_id, 0) + r.n_words
    assert max(fill.values()) <= 1000
    assert packing.pack(nothing).count() == 0


def test_neighbours(spark):
    v = [(1, [0.0, 0.0], "c"), (2, [1.0, 0.0], "c"), (3, [1.0, 0.0], "c"), (3, [1.0, 0.0], "c"), (4, None, "c"), (5, [], "c"), (6, [1.0], "c"), (7, [float("nan"), 0.0], "c"), (None, [0.0, 0.0], "c"), (8, [None, 1.0], "c")]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<float>, grp string")
    got = [(r.vec_id, r.neighbour_id, r.dist, r["rank"]) for r in ann_tree.neighbours(df, k=5).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 2, 1.0, 1), (1, 3, 1.0, 2), (2, 3, 0.0, 1), (2, 1, 1.0, 2), (3, 2, 0.0, 1), (3, 1, 1.0, 2)]
    assert ann_tree.neighbours(df.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id bigint, embedding array<float>")
    assert ann_tree.neighbours(same, k=3, max_local=50).count() == 900


def test_rules(docs, nothing):
    assert _ids(quality_rules.judge(docs)) == ALL
    assert set(quality_rules.keep_passing(docs).columns) == set(docs.columns)
    assert quality_rules.judge(nothing).count() == 0
    assert quality_rules.keep_passing(nothing).count() == 0


def test_near_duplicates(docs, nothing):
    got = {(r.doc_id, r.kept_id) for r in near_dup.near_duplicates(docs).collect()}
    assert got == {(2, 1), (3, 1)}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert _ids(kept) == [1, 4, 5, 6, 7, 8, 9, 10, 10, 11, None]
    assert near_dup.near_duplicates(nothing).count() == 0
    assert near_dup.keep_one(nothing).count() == 0


def test_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(None, "one two three four"), (None, "one two three four"), (5, "a b c d e"), (5, "a b c d e"), (6, ""), (6, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in near_dup.keep_one(df).collect()) == [(False, 5), (False, 6), (True, 0)]


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, True), (2, "", True), (3, "https://www.Casino.example/a/#x", True), (4, "http://casino.example/a", True), (4, "http://casino.example/a", True), (None, "http://good.example/", True), (5, "http://good.example/" + "p" * 100_000, True)], "page_id bigint, url string, listed boolean")
    got = sorted(((r.page_id or 0), r.listed) for r in url_cascade.flag_listed(pages).collect())
    assert got == [(0, False), (1, False), (2, False), (3, True), (4, True), (4, True), (5, False)]
    assert url_cascade.flag_listed(pages.limit(0)).count() == 0
    chosen = spark.createDataFrame([("http://good.example",), ("http://absent.example",), (None,)], "url string")
    assert {r.page_id for r in url_cascade.flag_listed(pages, listed=chosen).where("listed").collect()} == {None}
    none = spark.createDataFrame([], "url string")
    assert url_cascade.flag_listed(pages, listed=none).where("listed").count() == 0
    assert url_cascade.flag_listed(pages, terms=()).where("listed").count() == 0
    assert url_cascade.flag_listed(pages, terms=("good.", "a|b")).where("listed").select("page_id").distinct().count() == 2
    assert url_cascade.flag_listed(pages, terms=("c.sino",)).where("listed").count() == 0


def test_classifier(docs, nothing, labels):
    assert _ids(quality_qda.classify(docs, labels)) == ALL
    assert quality_qda.keep_good(docs, labels).columns == docs.columns
    assert _ids(quality_qda.keep_good(docs, labels.limit(0))) == ALL
    assert quality_qda.classify(docs, labels.limit(0)).where("keep and score is null").count() == len(ALL)
    assert quality_qda.classify(nothing, labels).count() == 0
    assert quality_qda.keep_good(nothing, labels).count() == 0


def test_sharding(docs, nothing):
    got = hash_tree.assign(docs)
    assert _ids(got) == ALL
    assert got.where("doc_id = 2").distinct().count() == 1
    assert hash_tree.assign(nothing).count() == 0


def test_codec(docs, nothing):
    got = piece_codec.encode(docs)
    assert _ids(got) == ALL
    assert {(r.doc_id, r.ids is None, r.lossless) for r in got.collect()} == {(i, i == 4, None if i == 4 else True) for i in set(ALL)}
    back = {(r.doc_id, r.text) for r in piece_codec.decode(got).collect()}
    assert back == {(r.doc_id, r.text) for r in docs.collect()}
    assert piece_codec.encode(nothing).count() == 0


def test_secrets(docs, nothing):
    got = sorted((r.doc_id, r.rule, r.n) for r in secret_ledger.scan(docs).collect())
    assert got == [(10, "quoted_credential", 1), (10, "quoted_credential", 2)]
    clean = secret_ledger.redact(docs)
    assert clean.columns == docs.columns
    assert _ids(clean) == ALL
    assert secret_ledger.scan(clean).count() == 0
    assert clean.where("text like '%[quoted_credential]%' and n_chars = length(text)").count() == 2
    assert secret_ledger.scan(nothing).count() == 0
    assert secret_ledger.redact(nothing).count() == 0


def test_clashing_columns_keep_their_values(spark, docs, labels):
    kept = [quality_qda.keep_good(docs, labels, reject_below=-1e9), quality_rules.keep_passing(docs, fence=1e9), near_dup.keep_one(docs), secret_ledger.redact(docs)]
    for df in kept:
        assert df.columns == docs.columns and dict(df.dtypes) == dict(docs.dtypes)
        for r in df.collect():
            assert [r[c] for c in CLASHES] == CLASHES and r["h"] == "clash" and r["size"] == 1
    assert all(df.count() == docs.count() for df in (kept[0], kept[1], kept[3]))


def test_a_value_at_the_threshold_passes(spark):
    """All texts alike: every statistic is at its quartiles, and a fence of no width lets them pass; the classifier keeps a score at its limit."""
    same = spark.createDataFrame([(i, "a b c d e f", "en", "a") for i in range(50)], "doc_id bigint, text string, lang string, source string")
    assert quality_rules.judge(same, fence=0.0).where("keep").count() == 50
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    judged = quality_qda.classify(same, labels)
    score = judged.first().score
    assert quality_qda.classify(same, labels, reject_below=score).where("keep").count() == 50


@pytest.mark.parametrize("name", ["empty"])
def test_pipeline_on_an_empty_table(spark, tmp_path, nothing, labels, name):
    nothing.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, nothing, sf, name, stage):
    out = stage(spark, docs, sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert stage(spark, nothing, sf).count() == 0
