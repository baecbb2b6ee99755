"""Load a table from CSV, JSON or parquet files, folders or globs."""

from __future__ import annotations

import csv
import json
import re
from functools import reduce
from operator import add
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import AGG_FIELDS, chunks, col, normalize_missing
from insight_spark.sources.records import ends_open, records
from insight_spark.sources.scratch import scratch_dir

# fixed values: file suffix to format
SUFFIXES = {".csv": "csv", ".parquet": "parquet", ".jsonl": "json", ".ndjson": "json", ".json": "json"}

# fixed values: texts that stand for a missing value in CSV
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
WHOLE = r"^\s*[+-]?\d+\s*$"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"

REPLACEMENT = "�"

# encodings whose line breaks, commas and quotes are the bytes of ASCII
BYTEWISE = ("utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "latin1", "windows-1252", "cp1252")

# texts of headers that are compared; files seldom have more than one
HEADERS = 1000

# columns of the reader for rows it could not read as they are
BROKEN = "__broken_row"


def load_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | str | None = None,
               encoding: str = "auto", multiline: bool | None = None) -> DataFrame:
    """Read a table; the format follows the lower-cased suffix unless `fmt` names it.

    A `schema` saves the pass that infers types. With encoding "auto" a CSV that is
    not valid UTF-8 is read as latin-1 as a whole. `multiline` allows line breaks in quoted CSV
    fields, at the price of a pass that finds and writes the records; by default it is set where a line ends
    inside a quoted field. Without a schema nothing is lost or swapped silently: CSV rows with
    more fields than the header, files with another header, and broken JSON lines raise ValueError.
    """
    fmt = fmt or format_of(path)
    try:
        if fmt == "csv":
            df = _read_csv(spark, path, schema, encoding, multiline)
        elif fmt == "json":
            df = _read_json(spark, path, schema)
        elif fmt == "parquet":
            reader = spark.read.schema(schema) if schema else spark.read
            df = reader.parquet(path)
        else:
            raise ValueError(f"Unsupported format: {fmt}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    return normalize_missing(normalize_columns(df))


def format_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"Unsupported file type: {suffix}")
    return SUFFIXES[suffix]


def normalize_columns(df: DataFrame) -> DataFrame:
    """Drop index columns left over from a CSV export."""
    auto = [c for c in df.columns if c.strip().lower().startswith("unnamed:")]
    return df.select(*[col(c) for c in df.columns if c not in auto]) if auto else df


# --- CSV --------------------------------------------------------------------


def _read_csv(spark: SparkSession, path: str, schema, encoding: str, multiline: bool | None) -> DataFrame:
    charset = "UTF-8" if encoding == "auto" else encoding
    if multiline is None:
        multiline = has_open_quotes(spark, path)
    if multiline and charset.lower() in BYTEWISE and not has_lone_returns(spark, path):
        df = _read_records(spark, path, schema, encoding)
        if df is not None:
            return df
    reader = spark.read.option("escape", '"').option("multiLine", multiline)
    if schema is not None:
        df = reader.schema(schema).csv(path, header=True, encoding=charset)
        if encoding == "auto" and not is_utf8(spark, path):
            df = reader.schema(schema).csv(path, header=True, encoding="ISO-8859-1")
        return df

    def texts(charset: str) -> tuple[DataFrame, dict, bool]:
        first = reader.csv(path, header=False, encoding=charset).first()
        header = [] if first is None else list(first)
        names = column_names(header)
        # a header that gives the names as they are is compared with that of every file
        read = reader.option("enforceSchema", names != header).option("columnNameOfCorruptRecord", BROKEN)
        fields = [T.StructField(n, T.StringType()) for n in names]
        kept = read.schema(T.StructType([*fields, T.StructField(BROKEN, T.StringType())]))
        checked = kept.csv(path, header=True, encoding=charset)
        # rows with fewer fields are filled up, those with more must not be cut
        wider = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
        surplus = F.from_csv(col(BROKEN), wider.simpleString()[7:-1].replace(":", " "), {"escape": '"'})[f"c{len(names)}"]
        try:
            types, replaced = infer_types(
                blank_missing(checked.select(*[col(n) for n in names], surplus.alias(BROKEN))), REPLACEMENT, BROKEN)
        except Exception as e:
            if "CSV header" in str(e):  # a task's error, wrapped in different types
                raise ValueError(f"The files have different headers: {path}") from e
            raise
        df = blank_missing(read.schema(T.StructType(fields)).csv(path, header=True, encoding=charset))
        return df, types, replaced or any(REPLACEMENT in n for n in names)

    df, types, replaced = texts(charset)
    if encoding == "auto" and replaced and not is_utf8(spark, path):
        df, types, _ = texts("ISO-8859-1")
    return df.select(*[types[c](col(c)).alias(c) for c in df.columns])


def column_names(header: list[str | None]) -> list[str]:
    """Names of a header row: blank ones become `Unnamed: n`, repeated ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for i, name in enumerate(header):
        name = name if name and name.strip() else f"Unnamed: {i}"
        key = name.lower()  # Spark resolves names without case
        seen[key] = seen.get(key, -1) + 1
        names.append(f"{name}.{seen[key]}" if seen[key] else name)
    return names


def _read_records(spark: SparkSession, path: str, schema, encoding: str) -> DataFrame | None:
    """CSV with line breaks inside quotes: records are found by many tasks a file, written, and parsed one by one.

    None where no file has a header.
    """
    stored = f"{scratch_dir(spark)}/records"
    records(spark, path).write.parquet(stored)
    kept = spark.read.parquet(stored)
    text = F.col("value").cast("string")
    if encoding == "auto" and not kept.filter(~F.is_valid_utf8(text)).limit(1).isEmpty():
        text = F.decode("value", "ISO-8859-1")
    elif encoding.lower() not in ("auto", "utf-8", "utf8"):
        text = F.decode("value", encoding)
    headers = kept.filter("header").select(F.make_valid_utf8(text)).distinct().limit(HEADERS).collect()
    if not headers:
        return None
    seen = [next(csv.reader([h[0].removesuffix("\r")])) for h in headers]
    names = column_names(seen[0])
    by_name = schema is None and names == seen[0]
    if by_name and any(h != names for h in seen):
        raise ValueError(f"The files have different headers: {path}")
    body = kept.filter("NOT header").select(F.make_valid_utf8(F.rtrim(text, F.lit("\r"))).alias("value"))
    fields = T.StructType([T.StructField(n, T.StringType()) for n in names]) if schema is None else (
        schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))
    n = len(fields)
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)) + f", c{n} string"
    parsed = body.select(F.from_csv("value", ddl, {"escape": '"', "multiLine": "true"}).alias("r"))
    df = parsed.select(*[F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(fields)], F.col(f"r.c{n}").alias(BROKEN))
    if schema is not None:
        return df.select(*[col(f.name) for f in fields])
    types, _ = infer_types(blank_missing(df), None, BROKEN)
    return blank_missing(df).select(*[types[c](col(c)).alias(c) for c in names])


def has_open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether any line ends inside a quoted field; quotes elsewhere in a field do not count."""
    return not spark.read.text(path).filter(ends_open(F.col("value"))).limit(1).isEmpty()


def has_lone_returns(spark: SparkSession, path: str) -> bool:
    """Whether there are carriage returns that are not part of a line's end; only a whole-file reader tells what they are."""
    inside = F.contains(F.rtrim("value", F.lit("\r")), F.lit("\r"))
    return not spark.read.text(path, lineSep="\n").filter(inside).limit(1).isEmpty()


def is_utf8(spark: SparkSession, path: str) -> bool:
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    return bad.isEmpty()


def blank_missing(df: DataFrame) -> DataFrame:
    """NULL for every text that stands for a missing value."""
    return df.select(*[F.when(~col(c).isin(*NA_TOKENS), col(c)).alias(c) for c in df.columns])


def _long(c: Column) -> Column:
    return F.when(c.rlike(WHOLE), c.try_cast("bigint"))  # a failing cast costs far more than the pattern


def _double(c: Column) -> Column:
    number = F.when(c.rlike(NUMBER), c.try_cast("double"))
    endless = F.when(F.trim(c).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.coalesce(number, F.when(c.rlike(INFINITY), endless))


def _boolean(c: Column) -> Column:
    return F.when(c.isin(*TRUE_TOKENS), F.lit(True)).when(c.isin(*FALSE_TOKENS), F.lit(False))


def _text(c: Column) -> Column:
    return c


# the first type that reads every value of a column wins
LADDER = (_long, _double, _boolean)


def infer_types(df: DataFrame, look_for: str | None = None, empty: str | None = None) -> tuple[dict, bool]:
    """(cast per column, whether any value contains `look_for`) over all rows.

    One pass: a column folds to one mask with a bit for every type that reads all its values. A value in
    the column `empty` raises ValueError.
    """
    clean = 1 << len(LADDER)
    types: dict = {}
    hit = False
    for batch in chunks(df.columns, AGG_FIELDS):
        row = df.agg(*[F.bit_and(_fits(col(c), look_for)).alias(f"m{i}") for i, c in enumerate(batch)]).first()
        for i, c in enumerate(batch):
            mask = row[f"m{i}"]  # NULL where the column has no value
            if c == empty and mask is not None:
                raise ValueError("There are rows with more fields than the header")
            types[c] = _double if mask is None else next((t for j, t in enumerate(LADDER) if mask >> j & 1), _text)
            hit = hit or (mask is not None and not mask & clean)
    return types, hit


def _fits(c: Column, look_for: str | None) -> Column:
    """Bits of the types that read a value, and one for a value without `look_for`; NULL for NULL."""
    bits = [F.when(cast(c).isNotNull(), F.lit(1 << j)).otherwise(0) for j, cast in enumerate(LADDER)]
    if look_for:
        bits.append(F.when(F.contains(c, F.lit(look_for)), F.lit(0)).otherwise(1 << len(LADDER)))
    else:
        bits.append(F.lit(1 << len(LADDER)))
    return F.when(c.isNotNull(), reduce(add, bits))


# --- JSON -------------------------------------------------------------------


def _broken_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).text(path)
    return lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNull())


def _raise_if_lines(spark: SparkSession, path: str, broken: DataFrame) -> None:
    """Where the first line is an object of its own, the others should be, too."""
    first = spark.read.text(path).filter(F.trim("value") != "").first().value
    if _is_object(first):
        raise ValueError(f"{broken.count()} lines are not JSON: {path}")


def _read_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON Lines; files whose first line is not a whole object hold one document each and are read as a whole.

    A broken line among others raises ValueError, with a given schema as well. A .json file of a single line may
    also hold whole columns.
    """
    if schema is not None:
        broken = _broken_lines(spark, path)
        if broken.isEmpty():
            return spark.read.schema(schema).json(path)
        _raise_if_lines(spark, path, broken)
        return spark.read.schema(schema).json(path, multiLine=True)
    reader = spark.read.option("columnNameOfCorruptRecord", BROKEN)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if not path.lower().endswith(".json") or lines.limit(2).count() != 1:
        df = reader.json(path)
        if BROKEN not in df.columns:
            return df
        _raise_if_lines(spark, path, _broken_lines(spark, path))
    return _read_columns(spark, path) or _read_whole(reader, path)


def _read_whole(reader, path: str) -> DataFrame:
    document = reader.json(path, multiLine=True)
    if BROKEN in document.columns:
        raise ValueError(f"Not valid JSON: {path}")
    return document


def _is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def _read_columns(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of objects that hold whole columns, as arrays or by row label; None of any other document.

    Documents are parsed as variants, so that a label is a row from the start and never a field of a schema. The
    driver sees one row per column.
    """
    whole = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    docs = whole.select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("doc"))
    columns = docs.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^(ARRAY|OBJECT)<", 1)
    names = columns.groupBy("key").agg(F.min(kind).alias("low"), F.max(kind).alias("high")).collect()
    kinds = {k for r in names for k in (r.low, r.high)}
    # no key: an array, a single value, or a text that is not JSON
    if any(r.key is None for r in names) or kinds not in ({"ARRAY"}, {"OBJECT"}):
        return None
    parts = columns.select("file", F.col("key").alias("name"), F.col("value").alias("part"))
    cells = parts.lateralJoin(spark.tvf.variant_explode(F.col("part").outer())).filter("pos IS NOT NULL")
    cells = cells.select("file", "name", "pos", F.coalesce("key", F.col("pos").cast("string")).alias("label"), "value")
    types = {r.name: _ddl(r.kind) for r in cells.groupBy("name").agg(F.schema_of_variant_agg("value").alias("kind")).collect()}

    def cell(name: str) -> Column:
        value = F.variant_get("value", "$", types.get(name, "string"))
        return F.first(F.when(F.col("name") == name, value), ignorenulls=True)

    wanted = sorted(r.key for r in names)
    rows = cells.groupBy("file", "label").agg(
        F.min("pos").alias("pos"), *[cell(n).alias(f"c{i}") for i, n in enumerate(wanted)])
    return rows.orderBy("file", "pos").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(wanted)])


def _ddl(kind: str) -> str:
    """Type of a column whose values have this variant schema; without a common type they stay as they are written."""
    kind = re.sub(r"DECIMAL\(\d+,([1-9]\d*)\)", "DOUBLE", kind)
    return re.sub("VOID|VARIANT", "STRING", kind.replace("OBJECT<", "STRUCT<"))
