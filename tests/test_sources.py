import json
import math

import pytest
from pyspark.sql import functions as F

from insight_spark.sources import load, sinks
from insight_spark.sources.load import load_table
from insight_spark.sources.scratch import scratch_dir, shared_dir


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def load_rows(spark, path, **kw):
    df = load.load_table(spark, path, **kw)
    return df.dtypes, [tuple(r) for r in df.collect()]


def test_csv_types(spark, tmp_path):
    path = write(tmp_path, "t.CSV", "i,d,b,s,n\n1,1.5,True,x,\n-2,2e3,false,3a,NA\n")
    types, rows = load_rows(spark, path)
    assert types == [("i", "bigint"), ("d", "double"), ("b", "boolean"), ("s", "string"), ("n", "double")]
    assert rows == [(1, 1.5, True, "x", None), (-2, 2000.0, False, "3a", None)]


@pytest.mark.parametrize(
    ("values", "dtype", "first"),
    [
        (["NA", "3"], "bigint", None),
        (["nan", "3.0"], "double", None),
        (["1", "x"], "string", "1"),
        (["1d", "2f"], "string", "1d"),
        (["yes", "no"], "string", "yes"),
        (["inf", "-Infinity"], "double", math.inf),
        (["9223372036854775808", "1"], "double", 9223372036854775808.0),
        (["None", "null"], "double", None),
        ([" 7", "8 "], "bigint", 7),
    ],
)
def test_csv_value_rules(spark, tmp_path, values, dtype, first):
    path = write(tmp_path, "t.csv", "n,k\n" + "".join(f"{v},1\n" for v in values))
    types, rows = load_rows(spark, path)
    assert types[0] == ("n", dtype) and rows[0][0] == first


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = write(tmp_path, "t.csv", 'a,b\n"x ""y"", z",1\n"two\nlines",2\n')
    _, rows = load_rows(spark, path, multiline=True)
    assert rows == [('x "y", z', 1), ("two\nlines", 2)]


def test_csv_latin1(spark, tmp_path):
    path = write(tmp_path, "t.csv", b"x,n\ncaf\xe9,1\nplain,2\n")
    assert load_rows(spark, path)[1] == [("café", 1), ("plain", 2)]


def test_csv_latin1_header_only(spark, tmp_path):
    path = write(tmp_path, "t.csv", b"caf\xe9,n\nx,1\n")
    assert load.load_table(spark, path).columns == ["café", "n"]


def test_csv_with_a_real_replacement_character(spark, tmp_path):
    path = write(tmp_path, "t.csv", "x\na�b\né\n")
    assert load_rows(spark, path)[1] == [("a�b",), ("é",)]


def test_csv_index_columns(spark, tmp_path):
    path = write(tmp_path, "t.csv", ",Unnamed: 1, UNNAMED: x,a,a,A\n0,1,2,3,4,5\n")
    types, rows = load_rows(spark, path)
    assert [c for c, _ in types] == ["a", "a.1", "A.2"] and rows == [(3, 4, 5)]


def test_csv_with_schema(spark, tmp_path):
    path = write(tmp_path, "t.csv", b"x,n\ncaf\xe9,1\n")
    types, rows = load_rows(spark, path, schema="x string, n int")
    assert types == [("x", "string"), ("n", "int")] and rows == [("café", 1)]


def test_csv_header_without_rows(spark, tmp_path):
    df = load.load_table(spark, write(tmp_path, "t.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_folder_and_glob(spark, tmp_path):
    write(tmp_path, "p1.csv", "a\n1\n")
    write(tmp_path, "p2.csv", "a\n2\n")
    assert load.load_table(spark, str(tmp_path), fmt="csv").count() == 2
    assert load.load_table(spark, f"{tmp_path}/*.csv").count() == 2


def test_json_lines_and_document(spark, tmp_path):
    lines = write(tmp_path, "a.jsonl", '{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert load_rows(spark, lines)[1] == [(1, "x"), (2, None)]
    pretty = json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}], indent=2)
    for name in ("d.jsonl", "d.ndjson", "d.json"):
        assert load_rows(spark, write(tmp_path, name, pretty))[1] == [(1, "x"), (2, "y")]


@pytest.mark.parametrize(
    "content",
    [{"a": [1, 2], "b": ["x", "y"]}, {"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": "y"}}],
)
def test_json_document_of_columns(spark, tmp_path, content):
    path = write(tmp_path, "c.json", json.dumps(content, indent=1))
    assert load_rows(spark, path)[1] == [(1, "x"), (2, "y")]


def test_json_document_with_array_cells(spark, tmp_path):
    path = write(tmp_path, "c.json", json.dumps([{"a": [1]}, {"a": [2, 3]}], indent=1))
    assert load_rows(spark, path)[1] == [([1],), ([2, 3],)]


def test_unreadable_inputs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load.load_table(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError, match="Unsupported file type: .xml"):
        load.load_table(spark, str(tmp_path / "t.xml"))
    with pytest.raises(ValueError, match="Not valid JSON"):
        load.load_table(spark, write(tmp_path, "b.json", "{broken"))


def test_parquet_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, a int").write.parquet(path)
    assert sorted(load_rows(spark, path)[1], key=repr) == [(2.0, 2), (None, 1)]


def test_report_json(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [(1.0, [nan, 2.0], {"k": inf}, (inf, "x")), (-inf, None, None, None)],
        "a double, b array<double>, c map<string,double>, d struct<p: double, q: string>",
    )
    got = [json.loads(r.json) for r in sinks.to_report_json(df).collect()]
    assert got[0] == {"a": 1.0, "b": [None, 2.0], "c": {"k": None}, "d": {"p": None, "q": "x"}}
    assert got[1] == {"a": None, "b": None, "c": None, "d": None}


def test_chart_csv(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([('a"b', None, 1.5)], "x string, y string, z double")
    sinks.write_chart_csv(df.coalesce(1), path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert text == '"x","y","z"\n"a""b","","1.5"\n'


def test_union_of_chart_tables(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert sorted(map(tuple, sinks.union_rows([a, b]).collect()), key=repr) == [(1, None), (None, 2)]


def test_report_files(spark, tmp_path):
    lines = spark.createDataFrame(
        [("d", 1, i, f"line {i}") for i in range(1, 30)], "dataset string, section_no int, line_no int, line string"
    )
    path = tmp_path / "report"
    sinks.write_report_lines(lines.repartition(5), str(path))
    parts = list(path.glob("dataset=d/*.txt"))
    assert len(parts) == 1 and parts[0].read_text().splitlines() == [f"line {i}" for i in range(1, 30)]


def test_profile_files(spark, tmp_path):
    written = sinks.write_profile({"t": spark.range(2)}, str(tmp_path), "my data/x")
    assert written == [f"{tmp_path}/my_data_x.profile/t"]
    assert spark.read.parquet(written[0]).count() == 2


def test_scratch_folder_is_new_and_shared(spark):
    assert scratch_dir(spark) != scratch_dir(spark)
    assert scratch_dir(spark).startswith(shared_dir(spark).rstrip("/"))


def test_inference_over_many_columns(spark, tmp_path):
    names = [f"c{i}" for i in range(45)]
    path = write(tmp_path, "w.csv", ",".join(names) + "\n" + ",".join(str(i) for i in range(45)) + "\n")
    df = load.load_table(spark, path)
    assert set(dict(df.dtypes).values()) == {"bigint"} and df.agg(F.sum("c44")).first()[0] == 44


def _write(tmp_path, name, text):
    target = tmp_path / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
    return str(target)


def test_csv_loses_and_swaps_nothing(spark, tmp_path, rows):
    path = _write(tmp_path, "breaks.csv", 'id,t\n1,"two\nlines"\n2,x\n')
    assert rows(load_table(spark, path)) == [(1, "two\nlines"), (2, "x")]
    _write(tmp_path, "mixed.csv/a.csv", "id,v\n1,10\n")
    _write(tmp_path, "mixed.csv/b.csv", "v,id\n20,2\n")
    with pytest.raises(ValueError, match="different headers"):
        load_table(spark, str(tmp_path / "mixed.csv"))
    with pytest.raises(ValueError, match="more fields"):
        load_table(spark, _write(tmp_path, "wide.csv", "a,b\n1,10,99\n2,3\n"))
    assert rows(load_table(spark, _write(tmp_path, "short.csv", "a,b,c\n1,10\n2,3,4\n"))) == [(1, 10, None), (2, 3, 4)]


def test_broken_json_line_raises(spark, tmp_path, rows):
    with pytest.raises(ValueError, match="1 lines are not JSON"):
        load_table(spark, _write(tmp_path, "bad.jsonl", '{"a":1}\n{"a":2}\n{"a":\n{"a":4}\n'))
    path = _write(tmp_path, "named.jsonl", '{"_corrupt_record":"x","a":1}\n{"a":2}\n')
    assert load_table(spark, path).count() == 2


def test_json_columns_on_one_line_or_many(spark, tmp_path, rows):
    want = [(1, "x"), (2, "y"), (3, "z")]
    for name, text in (("one", '{"a":[1,2,3],"b":["x","y","z"]}'), ("many", '{\n"a":[1,2,3],\n"b":["x","y","z"]}')):
        assert rows(load_table(spark, _write(tmp_path, f"{name}.json", text))) == want
    labelled = {"a": {str(i): i for i in range(300)}, "b": {str(i): f"v{i}" for i in range(300)}}
    got = load_table(spark, _write(tmp_path, "labels.json", json.dumps(labelled)))
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"v{i}") for i in range(300)]


def test_broken_json_line_with_a_schema(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    with pytest.raises(ValueError, match="1 lines are not JSON"):
        load_table(spark, str(path), schema="a int")
    path.write_text('{"a": 1}\n\n{"a": "x"}\n')
    assert sorted((r.a for r in load_table(spark, str(path), schema="a int").collect()), key=repr) == [1, None]


def test_json_document_with_a_schema(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[\n  {"a": 1},\n  {"a": 2}\n]\n')
    assert sorted(r.a for r in load_table(spark, str(path), schema="a int").collect()) == [1, 2]


@pytest.mark.parametrize("labels", [15, 1500])
def test_json_labels_are_rows_not_fields(spark, tmp_path, labels):
    n = range(labels)
    columns = {
        "i": {f"r{k}": k for k in n}, "d": {f"r{k}": k + 0.5 if k % 2 else k for k in n}, "s": {f"r{k}": f"v {k}" for k in n},
        "m": {f"r{k}": "x" if k % 2 else k for k in n}, "z": {f"r{k}": None for k in n}, "a": {"r1": [1, 2], "extra": None},
    }
    want = sorted([(None if k != 1 else [1, 2], k + 0.5 * (k % 2), k, "x" if k % 2 else str(k), f"v {k}", None) for k in n]
                  + [(None,) * 6], key=repr)
    for indent in (None, 1):
        df = load_table(spark, _write(tmp_path, f"labels{indent}.json", json.dumps(columns, indent=indent)))
        assert df.dtypes == [("a", "array<bigint>"), ("d", "double"), ("i", "bigint"), ("m", "string"), ("s", "string"), ("z", "string")]
        assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_json_documents_that_hold_no_columns(spark, tmp_path, rows):
    assert rows(load_table(spark, _write(tmp_path, "one.json", '{"a": 1, "b": [2]}'))) == [(1, [2])]
    assert rows(load_table(spark, _write(tmp_path, "list.json", '[{"a": 1}, {"a": 2}]'))) == [(1,), (2,)]
    _write(tmp_path, "many.json/1.json", '{"a": [1, 2], "b": ["x"]}')
    _write(tmp_path, "many.json/2.json", '{"a": {"k": 3}, "b": {"k": "z"}}')
    assert load_table(spark, str(tmp_path / "many.json")).count() == 2
    _write(tmp_path, "both.json/1.json", '{\n"a": [1, 2], "b": ["x"]}')
    _write(tmp_path, "both.json/2.json", '{\n"a": [3], "b": []}')
    assert rows(load_table(spark, str(tmp_path / "both.json"))) == [(1, "x"), (2, None), (3, None)]
