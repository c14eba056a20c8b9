"""CSV files of any text, cut into chunks at any place."""

import csv
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockpipe import sources as io
from blockpipe.sources.csv import csv_records, inside_after
from tests.oracle import duck, rows

ODD = ['say "hi", ok', "two\nlines", "plain", "", " blanks ", "a,b", '"', 'x\n"\n,', "cr\r\nlf", "é\n ", '""', ",\n,"]


@pytest.fixture()
def chunks(spark):
    """Sets the size of the pieces files are read in."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def cut(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "1")

    yield cut
    for n, v in before.items():
        spark.conf.set(n, v)


def written(path, seed=3, n=150, end="\r\n", header=("id", "text", "k")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([*ODD, "\n\n\n" * rng.randrange(1, 40) + '"'])
        out.append((i + 1000 * seed, text, rng.choice(["x", "y,z", 'q"q'])))
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        if header:
            w.writerow(header)
        w.writerows(out)
    return out


@pytest.mark.parametrize("end", ["\r\n", "\n"])
@pytest.mark.parametrize("size", ["64m", "1k", "200b"])
def test_records_are_those_of_pandas_however_the_file_is_cut(spark, tmp_dir, chunks, size, end):
    want = written(f"{tmp_dir}/a.csv", end=end)
    assert pd.read_csv(f"{tmp_dir}/a.csv", keep_default_na=False)["text"].str.len().tolist() == [len(t) for _, t, _ in want]
    chunks(size)
    df = io.read_csv(spark, f"{tmp_dir}/a.csv")
    assert df.schema.simpleString() == "struct<id:int,text:string,k:string>"
    assert sorted((r["id"], r["text"] or "", r["k"]) for r in df.collect()) == want
    if size != "64m":
        many = csv_records(spark, f"{tmp_dir}/a.csv").select(F.spark_partition_id()).distinct().count()
        assert many >= 4


def test_several_files_with_and_without_header(spark, tmp_dir, chunks):
    import os

    chunks("400b")
    os.mkdir(f"{tmp_dir}/with")
    os.mkdir(f"{tmp_dir}/without")
    want = []
    for seed in (1, 2, 3):
        want += written(f"{tmp_dir}/with/{seed}.csv", seed, 60)
        written(f"{tmp_dir}/without/{seed}.csv", seed, 60, header=None)
    got = io.read_csv(spark, f"{tmp_dir}/with", schema="id long, text string, k string").collect()
    assert sorted((r[0], r[1] or "", r[2]) for r in got) == sorted(want)
    bare = io.read_csv(spark, f"{tmp_dir}/without", header=False)
    assert bare.columns == ["_c0", "_c1", "_c2"]
    assert sorted((r[0], r[1] or "", r[2]) for r in bare.collect()) == sorted(want)


def test_quotes_inside_unquoted_values_are_text(spark, tmp_dir, chunks):
    chunks("20b")
    with open(f"{tmp_dir}/q.csv", "w") as f:
        f.write('size,name\n5" pipe,a\n6" pipe,"b\nc"\n"7"" pipe",d"\n\n,""\n')
    got = [tuple(r) for r in io.read_csv(spark, f"{tmp_dir}/q.csv").collect()]
    assert sorted(got, key=str) == sorted([('5" pipe', "a"), ('6" pipe', "b\nc"), ('7" pipe', 'd"'), (None, "")], key=str)


def test_types_are_inferred_from_all_rows(spark, tmp_dir):
    with open(f"{tmp_dir}/t.csv", "w") as f:
        f.write("i,l,d,day,at,b,s,e\n1,5000000000,1.5,2024-01-02,2024-01-02 03:04:05,true,x,\n,2,3,2024-02-03,2024-02-03,false,2,\n")
    df = io.read_csv(spark, f"{tmp_dir}/t.csv")
    kinds = dict(df.dtypes)
    assert kinds == {"i": "int", "l": "bigint", "d": "double", "day": "date", "at": "timestamp", "b": "boolean", "s": "string", "e": "string"}
    assert df.where("i is null").select("l", "d", "s").first() == (2, 3.0, "2")


def test_state_at_the_end_of_a_line():
    cases = {'a,"b': (True, False), 'a,"b""': (True, False), 'a,"b"': (False, False), "a": (False, True), '"': (True, False), '""': (False, True)}
    for line, (outside, inside) in cases.items():
        assert inside_after(line, False) == outside, line
        assert inside_after(line, True) == inside, line
    assert not inside_after('5" pipe', False) and inside_after('5"" pipe', True)


def test_other_options_use_sparks_reader(spark, tmp_dir):
    with open(f"{tmp_dir}/l.csv", "wb") as f:
        f.write("a;b\n1;é\n".encode("latin-1"))
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_dir}/l.csv", sep=";", encoding="iso-8859-1").collect()] == [(1, "é")]
    spark.createDataFrame([(1, "x")], "a int, p string").write.partitionBy("p").option("header", True).csv(f"{tmp_dir}/parts")
    assert [tuple(r) for r in io.read_csv(spark, f"{tmp_dir}/parts").collect()] == [(1, "x")]


def test_empty_file_and_header_only(spark, tmp_dir):
    open(f"{tmp_dir}/h.csv", "w").write("a,b\n")
    df = io.read_csv(spark, f"{tmp_dir}/h.csv")
    assert df.columns == ["a", "b"] and df.count() == 0
    assert io.read_csv(spark, f"{tmp_dir}/h.csv", schema="a int, b string").count() == 0


def test_binary_and_nested_values_come_back_from_csv(spark, tmp_dir):
    df = spark.sql(
        "select X'00FF0A22' as b, named_struct('x', 1, 't', timestamp'2024-01-02 03:04:05.000006', 's', 'a\"\n') as s, "
        "array(1, null) as a, map('k', cast('NaN' as double)) as m union all select null, null, null, null"
    )
    back = io.move(spark, df, f"{tmp_dir}/n", destination_fmt="csv")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert str(sorted(back.collect(), key=str)) == str(sorted(df.collect(), key=str))
    again = io.read_export(spark, io.export_csv(df, f"{tmp_dir}/e"), df.schema)
    assert str(sorted(again.collect(), key=str)) == str(sorted(df.collect(), key=str))


def test_documents_come_back_with_defaults(spark, chunks):
    from blockpipe import suite

    chunks("16k")
    sf = "/root/testdata/sf0.001"
    got = suite.QUERIES["read_csv_documents"](spark, sf).toPandas()
    assert rows(got, 6) == rows(duck(sf).sql("select * from documents").df(), 6)
