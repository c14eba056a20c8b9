"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import pathlib
import re
import textwrap

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from blockpipe.llm import ann, decontaminate, language, licenses, neardup, packing, queries, shards, toxicity, urls, warc
from blockpipe.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Some words of a long text. " * 40_000
PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_documents(spark):
    plain = "The quick brown fox jumps over the lazy dog near the river bank today."
    rows = [
        (1, plain, "en", "a", 5),
        (1, plain, "en", "a", 5),
        (2, plain, "en", None, None),
        (3, None, "en", "a", 0),
        (4, "", None, "a", 0),
        (5, "", "en", "a", 0),
        (6, "!!! ???", "en", "a", 0),
        (7, "12 34", "en", "a", 0),
        (None, plain, "en", "a", 0),
        (None, None, None, None, None),
        (8, LONG, "en", "a", 0),
        (9, "Kurz.", "de", "a", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(50, 51), (51, 50), (7, 7), (None, 3), (90, 80), (90, 70), (80, 90)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 10 for i in range(10, 41)} | {50: 50, 51: 50, 90: 70, 80: 70, 70: 70}
    assert sorted((r.id, r.component) for r in got) == sorted(want.items())
    assert connected_components(empty(spark, "a long, b long")).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (2, [1.0, 0.0], "x"), (3, [0.0, 1.0], "x"),
        (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [1.0, None], "x"), (7, [nan, 1.0], "x"), (8, [inf, 1.0], "x"),
        (9, [], "x"), (None, [1.0, 0.0], "x"), (10, [1.0, 0.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    got = ann.nearest_neighbours(df, df.where("vec_id in (0, 3, 4, 5, 10)"), k=2).collect()
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in got}
    assert found == {
        (0, 1): (1, 0.0), (0, 2): (2, 0.0), (3, 1): (0, pytest.approx(2**0.5)), (3, 2): (1, pytest.approx(2**0.5)),
    }
    none = empty(spark, "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(none, df).count() == 0
    assert ann.nearest_neighbours(df, none).count() == 0


def test_shards(spark):
    docs = odd_documents(spark).withColumn("shard", F.lit("x")).withColumn("group", F.lit(1))
    got = shards.shard_rows(spark, docs, 5).toPandas()
    assert len(got) == 12 and got.groupby("shard").size().tolist() == [3, 3, 2, 2, 2]
    assert got["doc_id"].isna().sum() == 2 and got.columns.tolist().count("shard") == 1
    assert shards.shard_rows(spark, empty(spark, DOCS), 5).count() == 0
    again = shards.shard_rows(spark, docs, 40)
    assert again.count() == 12 and again.agg(F.max("slot")).first()[0] == 0


def test_archives(spark, tmp_dir):
    rows = [
        (1, "u", "é" * 60, "r"), (2, "u", "é" * 60, "r"), (2, "u", "é" * 60, "r"), (1, "u", "é" * 60, "r"),
        (3, None, None, "r"), (4, "a\r\nb", "", "r"), (None, "u", "é" * 60, "r"), (5, "u", LONG, "r"), (None, "u", "z" * 200, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    warc.write_warc(df, f"{tmp_dir}/w")
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "", r.payload_length) for r in warc.read_warc(spark, f"{tmp_dir}/w").collect())
    one = "<urn:record:1>"
    assert got == [
        ("", "response", "", 200), ("", "revisit", one, 120), (one, "response", "", 120), (one, "response", "", 120),
        ("<urn:record:2>", "revisit", one, 120), ("<urn:record:2>", "revisit", one, 120),
        ("<urn:record:3>", "response", "", 0), ("<urn:record:4>", "response", "", 0),
        ("<urn:record:5>", "response", "", len(LONG)),
    ]
    warc.write_warc(empty(spark, "page_id long, url string, html string"), f"{tmp_dir}/e")
    assert warc.read_warc(spark, f"{tmp_dir}/e").count() == 0


def test_classifiers(spark):
    docs = odd_documents(spark).withColumn("toxicity", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 1), (9, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model)
    assert got.columns.count("toxicity") == 1 and got.where("toxicity between 0 and 1").count() == 12
    assert toxicity.score_toxicity(empty(spark, DOCS), model).count() == 0
    untrained = toxicity.fit(docs, empty(spark, "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.score_toxicity(docs, untrained).collect()} == {0.5}

    model = language.fit(docs)
    got = language.identify(docs, model).toPandas()
    assert got.columns.tolist().count("lang_pred") == 1 and len(got) == 12
    no_letter = ~got["text"].fillna("").str.contains("[a-z]")
    assert (got[no_letter]["lang_pred"] == "und").all() and (got[no_letter]["lang_score"] == 0).all()
    assert got[no_letter]["lang_rejected"].all() and set(got[~no_letter]["lang_pred"]) <= {"de", "en"}
    assert language.identify(empty(spark, DOCS), model).count() == 0
    unknown = language.identify(docs, language.fit(empty(spark, DOCS))).collect()
    assert {(r.lang_pred, r.lang_rejected) for r in unknown} == {("und", True)}


def test_fits_take_one_row_of_an_id(spark, monkeypatch):
    ordinary = [f"the weather in town number{i} is fine and people walk along the river" for i in range(40)]
    insults = [f"you are a stinking grotbag and number{i} a vile snotling" for i in range(40)]
    once = [(i, t) for i, t in enumerate(ordinary + insults)] + [(80, "the harvest was good and bread is cheap")]
    copies = [once[-1]] * 3000 + [(80, "zz other text of the id")] * 2
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(81)], "doc_id long, toxic int")
    plain, repeated = (spark.createDataFrame(r, "doc_id long, text string") for r in (once, once + copies[:3000]))
    scores = []
    for docs in (plain, repeated):
        model = toxicity.fit(docs, labels)
        got = toxicity.score_toxicity(plain, model).orderBy("doc_id").collect()
        scores.append([r.toxicity for r in got])
    assert scores[1] == pytest.approx(scores[0], abs=1e-6)
    # several texts of an id: one counts, whatever the order of the rows
    models = [toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (once + copies, copies + once)]
    assert models[0].weights == pytest.approx(models[1].weights, abs=1e-6)

    seen = []
    def noted(examples, langs):
        seen.append(sorted((x.snippets, x.buckets.tolist(), x.many, lang) for x, lang in zip(examples, langs)))

    monkeypatch.setattr(language, "train", noted)
    english = [(i, t, "en") for i, t in once]
    german = [(100 + i, f"das Wetter in Stadt {i} ist gut", "de") for i in range(30)]
    for rows in (english + german, english + german + [english[0]] * 2000 + [english[7]] * 2000):
        language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50)
    assert seen[0] == seen[1] and len(seen[0]) == 80


def test_near_duplicates(spark):
    docs = odd_documents(spark).withColumn("class_id", F.lit("x"))
    got = sorted((r.doc_id or 0, r.class_id or 0, r.keep) for r in neardup.near_duplicates(docs).collect())
    assert got == [
        (0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True),
        (5, 4, False), (6, 6, True), (7, 7, True), (8, 8, True), (9, 9, True),
    ]
    assert neardup.near_duplicates(empty(spark, DOCS)).count() == 0


def test_url_filter(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 2), (3, "x://" + "a" * 10**6, 3)], "page_id long, url string, host int")
    got = urls.filter_urls(df).toPandas()
    assert len(got) == 4 and got.columns.tolist().count("host") == 1 and (got["verdict"] == "allow").all()
    assert urls.filter_urls(empty(spark, "page_id long, url string")).count() == 0
    assert urls.filter_urls(df, rules=[], strict=[], soft={}).count() == 4


def test_packing(spark):
    docs = odd_documents(spark).withColumn("length", F.lit("x"))
    got = packing.pack_documents(docs, PATH).toPandas()
    first = got[got["piece"] == 0]
    assert len(first) == 12 and first[first["doc_id"].isin([3, 4, 5])]["length"].tolist() == [1, 1, 1]
    assert got["length"].max() == 4096 and (got.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert packing.pack_documents(empty(spark, DOCS), PATH).count() == 0


def test_licenses(spark):
    mit = dict(licenses.KNOWN_LICENSES[:1])["MIT"]
    rows = [
        (1, mit), (2, "Copyright (c) 2020 Some One\n" + mit.upper().replace(", ", " ,\n")), (3, mit + " more"),
        (4, None), (5, ""), (6, "!!"), (6, "!!"), (7, "Words.\nReleased under the MIT licence!\nmore"), (8, LONG),
        (9, "Copyright 2020 X. All rights reserved."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("x"))
    got = {r.doc_id: (r.license, r.license_lines, r.license_digest is None) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "", False), 2: ("MIT", "", False), 3: (None, "", False), 4: (None, None, True), 5: (None, "", True),
        6: (None, "", True), 7: (None, "MIT", False), 8: (None, "", False), 9: (None, "", True),
    }
    assert licenses.scan_licenses(empty(spark, "doc_id long, text string")).count() == 0
    assert {r.license for r in licenses.scan_licenses(df, known=[]).collect()} == {None}


STATEMENT = re.compile(r"\s*(copyright\s*\(c\)|copyright \[yyyy\])", re.I)


def wrapped(text: str, width: int) -> str:
    """Every paragraph filled anew; lines that state a copyright stay alone."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        lines = [[]]
        for line in paragraph.split("\n"):
            if STATEMENT.match(line):
                lines += [[line], []]
            else:
                lines[-1].append(line)
        out.append("\n".join(textwrap.fill(" ".join(x), width, break_on_hyphens=False) for x in lines if x))
    return "\n\n".join(out)


def found_licenses(spark, rows):
    """license_digest -> licence by Spark, held against the SQL form."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df).collect()}
    con = duckdb.connect()
    table = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    con.register("documents", table)
    assert got == {r[0]: r[2] for r in con.execute(licenses.scan_sql()).fetchall()}
    return got


def test_licenses_in_any_wrapping(spark):
    known = licenses.known_licenses() if hasattr(licenses, "known_licenses") else licenses.KNOWN_LICENSES
    cases = [(name, wrapped(text, width)) for name, text in known for width in (60, 72, 80)]
    isc = dict(licenses.KNOWN_LICENSES)["ISC"].replace("copyright notice and this", "\ncopyright notice and this")
    cases += [("ISC", "(c) 2019 Some One\n© 2020 Other\nCopyright <year> A\nCopyright [2021] B\n" + isc)]
    got = found_licenses(spark, [(i, text) for i, (_, text) in enumerate(cases)])
    assert [(k, name) for k, (name, _) in enumerate(cases) if got[k] != name] == []


def test_whole_licenses_with_and_without_titles(spark):
    mit = dict(licenses.KNOWN_LICENSES[:1])["MIT"].partition("\n")[2]
    bsd = dict(licenses.KNOWN_LICENSES)["BSD-2-Clause"]
    cases = [("MIT", title + "\n\nCopyright (c) 2001 X\n\n" + mit) for title in ("", "The MIT License (MIT)", "MIT License")]
    cases += [("BSD-2-Clause", "BSD 2-Clause License\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* "))]
    names = {
        "Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0",
        "GFDL-1.2": "GFDL-1.2-only", "GFDL-1.3": "GFDL-1.3-only", "GPL-1": "GPL-1.0-only", "GPL-2": "GPL-2.0-only",
        "GPL-3": "GPL-3.0-only", "LGPL-2": "LGPL-2.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only",
        "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0",
    }
    folder = pathlib.Path(licenses.__file__).parent / "known_licenses"
    cases += [(name, (folder / f"{file}.txt").read_text()) for file, name in names.items()]
    terms = (folder / "Apache-2.0.txt").read_text()
    cases += [("Apache-2.0", terms[terms.index("TERMS AND") : terms.index("APPENDIX")]), (None, terms + " more")]
    got = found_licenses(spark, [(i, text) for i, (_, text) in enumerate(cases)])
    assert [got[i] for i in range(len(cases))] == [name for name, _ in cases]


def test_decontamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    bench = spark.createDataFrame(
        [(1, item), (1, item), (2, None), (3, ""), (4, "two words"), (None, item)], "item_id long, text string"
    )
    rows = [(1, "x " + item.upper() + "!"), (2, None), (3, ""), (4, "just TWO, words"), (5, item[:40]), (6, LONG + item), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(7))
    got = {(r.doc_id, r.item_id, round(r.similarity, 3)) for r in decontaminate.find_passages(docs, bench).collect()}
    assert got == {(1, 1, 1.0), (4, 4, 1.0), (6, 1, 1.0), (None, 1, 1.0)}
    many = decontaminate.find_passages(docs, bench, item_block=1).distinct()
    assert {(r.doc_id, r.item_id, round(r.similarity, 3)) for r in many.collect()} == got
    flags = decontaminate.flag_passages(docs, bench).collect()
    assert {r.doc_id for r in flags if r.contaminated} == {1, 4, 6, None}
    nothing = empty(spark, "item_id long, text string")
    assert decontaminate.find_passages(docs, nothing).count() == 0
    assert decontaminate.find_passages(empty(spark, "doc_id long, text string"), bench).count() == 0


def tables(spark, tmp_dir, docs):
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, "no such passage in any of these documents at all")], "item_id long, text string").write.parquet(
        f"{tmp_dir}/benchmark.parquet"
    )
    return tmp_dir


@pytest.mark.parametrize("kind", ["odd", "empty", "clashing"])
def test_stages_take_any_documents(spark, tmp_dir, kind):
    docs = odd_documents(spark) if kind != "empty" else empty(spark, DOCS)
    if kind == "clashing":
        for name in ("toxicity", "lang_pred", "contaminated", "keep", "class_id", "__w", "n", "w"):
            docs = docs.withColumn(name, F.lit("own"))
    sf = tables(spark, tmp_dir, docs)
    read = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, read, sf)
        assert out.columns == read.columns, name
        assert out.exceptAll(read).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() >= 0


def test_stage_decisions(spark, tmp_dir):

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.remove_near_duplicates(spark, docs, sf)
    classes = neardup.near_duplicates(docs).toPandas()
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(classes["class_id"].unique())
    hits = {r.doc_id for r in decontaminate.find_passages(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    clean = corpus_pipeline.remove_contaminated(spark, docs, sf)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - hits
    assert hits
    told = corpus_pipeline.identify_language(spark, docs, sf)
    assert told.count() >= 0.99 * docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() > 100


def test_every_query_is_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) <= set(found) and "pipeline" in found
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "toxicity", "near_duplicates", "decontamination", "packing"
    ]
