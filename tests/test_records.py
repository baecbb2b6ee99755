import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from insight_spark.sources import load, records


def random_csv(rng, rows, end):
    """Rows of awkward fields, as a CSV text with this line end, and what it says."""
    bits = ["a", "é", '"', '""', ",", "\n", "x y", "", "\n\n", '","', "'", "12"]
    data = [[str(i), *("".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(3))] for i in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["id", "a", "b", "c"], *data])
    return out.getvalue(), data


@pytest.mark.parametrize(("split", "end"), [(1 << 20, "\n"), (97, "\n"), (97, "\r\n"), (31, "\n")])
def test_records_are_those_of_a_sequential_reader(spark, tmp_path, split, end):
    rng = random.Random(split)
    want = []
    for name in ("x.csv", "y.csv"):
        text, data = random_csv(rng, 60, end)
        (tmp_path / name).write_bytes(text.encode())
        want += data
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    if split < 100:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        blocks = records.lines(spark, str(tmp_path)).select("file", "block").distinct().count()
        df = load.load_table(spark, str(tmp_path), fmt="csv", schema="id bigint, a string, b string, c string")
        got = sorted((r.id, r.a or "", r.b or "", r.c or "") for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert blocks > 20 if split < 100 else blocks == 2
    assert got == sorted((int(i), *rest) for i, *rest in want)


def test_a_file_of_many_splits_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("id,t\n" + "".join(f'{i},"two\nlines {i}"\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cut = records.records(spark, str(path))
        tasks = {r.p: r.n for r in cut.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
        df = load.load_table(spark, str(path))
        assert df.dtypes == [("id", "bigint"), ("t", "string")]
        assert df.filter(F.concat(F.lit("two\nlines "), "id") == F.col("t")).count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(tasks.values()) == 2001 and len(tasks) > 4 and max(tasks.values()) < 1000


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,size\n1,5" pipe\n2,3"\n3,"a ""b"", c"\n4,""\n')
    assert not load.has_open_quotes(spark, str(path))
    assert [r["size"] for r in load.load_table(spark, str(path)).orderBy("id").collect()] == ['5" pipe', '3"', 'a "b", c', None]


def test_a_quote_that_never_closes_and_latin1(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'id,t\n1,"caf\xe9\nnoir"\n2,"open\nto the end\n')
    got = {r.id: r.t for r in load.load_table(spark, str(path)).collect()}
    assert got[1] == "café\nnoir" and got[2].startswith("open\nto the end")


def test_records_keep_the_rules_of_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a\nb"\n')
    (tmp_path / "b.csv").write_text('t,id\n"c\nd",2\n')
    with pytest.raises(ValueError, match="different headers"):
        load.load_table(spark, str(tmp_path), fmt="csv")
    (tmp_path / "b.csv").write_text('id,t\n2,"c\nd",9\n')
    with pytest.raises(ValueError, match="more fields"):
        load.load_table(spark, str(tmp_path), fmt="csv")
