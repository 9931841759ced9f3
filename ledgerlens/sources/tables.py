"""Reading data sets: extension dispatch, header clean-up, date coercion by name."""
from __future__ import annotations

import csv
import io
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._cols import q
from ..functions.aggs import rows_of
from ..functions.schema import SEMANTIC_KEYWORDS
from ..session import stored
from .csv_ranges import LATIN1, UTF8, csv_records

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")
ALLOWED_EXTENSIONS = (".csv", ".parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a lazy Parquet scan (pushdown and pruning apply)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Cell texts that mean a missing value when a CSV file is read.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_INTEGER, _DECIMAL = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


_CSV = {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}


def _text_schema(n: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(n))


def _whole_files(spark: SparkSession, path: str, encoding: str | None):
    """Header cells and text rows by Spark's own reader, which takes a file with line breaks in cells as one piece."""
    if encoding is None:
        bad = spark.read.text(path).select(F.count_if(~F.is_valid_utf8("value")).alias("n")).first()["n"]
        encoding = LATIN1 if bad else UTF8
    reader = spark.read.options(encoding=encoding, multiLine=True, **_CSV)
    head = reader.option("header", False).csv(path).first()
    schema = None if head is None else _text_schema(len(head) + 1)
    return head, schema and reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A1 + A2: header row, typed columns; UTF-8 first, Latin-1 for a file whose bytes do not decode.

    Quoted cells may hold doubled quotes and line breaks, and large files are still read by many tasks
    (:mod:`.csv_ranges`; files with lone carriage returns or an encoding other than UTF-8 and Latin-1 take one task each).
    The usual missing-value tokens become NULL; a row with more cells than the header raises, a shorter one is filled with
    NULL. A column is whole numbers, numbers or true/false when all its values are, else text;
    one aggregate decides that for all columns.
    """
    records = csv_records(spark, path, encoding) if encoding in (None, UTF8, LATIN1) else None
    if records is None:
        head, raw = _whole_files(spark, path, encoding)
    else:
        records = stored(records, "csv-records")
        head = records.where("header").agg(F.min_by("text", "file").alias("h")).first()["h"]
        head = None if head is None else next(csv.reader(io.StringIO(head.lstrip("\ufeff"), newline="")))
        raw = None if head is None else records.where("NOT header").select(
            F.from_csv("text", F.lit(_text_schema(len(head) + 1)), _CSV).alias("r")).select("r.*")
    if head is None:
        raise ValueError("the file is empty")
    names = [str(c) if c not in (None, "") else f"Unnamed: {i}" for i, c in enumerate(head)]
    cells = [F.when(~F.col(f"_c{i}").isin(*MISSING_TOKENS), F.col(f"_c{i}")) for i in range(len(names))]
    text = raw.select(*[c.alias(f"_c{i}") for i, c in enumerate(cells)], F.col(f"_c{len(names)}").alias("_more"))
    kinds = [F.count("_more").alias("more")]
    for i in range(len(names)):
        c = F.col(f"_c{i}")
        kinds += [F.count(c).alias(f"n{i}"), F.count_if(c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull()).alias(f"i{i}"),
                  F.count_if(c.rlike(_DECIMAL)).alias(f"d{i}"), F.count_if(F.lower(c).isin("true", "false")).alias(f"b{i}")]
    seen = text.agg(*kinds).first()
    if seen["more"]:
        raise ValueError(f"{seen['more']} rows have more cells than the header")

    def typed(i):
        n = seen[f"n{i}"]
        kind = ("double" if n == 0 else "bigint" if seen[f"i{i}"] == n else "double" if seen[f"d{i}"] == n
                else "boolean" if seen[f"b{i}"] == n else None)
        c = F.col(f"_c{i}")
        return (F.trim(c).cast(kind) if kind else c).alias(f"_c{i}")

    return clean_headers(text.select(*[typed(i) for i in range(len(names))]).toDF(*names))


def read_dataset(spark: SparkSession, path: str, coerce_dates: bool = True) -> DataFrame:
    """A3: dispatch on extension; unknown extension or parse failure -> ValueError.

    Applies A4 (header clean-up) and A5 (date coercion by column name).
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in ALLOWED_EXTENSIONS:
        raise ValueError(f"Unsupported file type: {os.path.basename(path)}")
    try:
        df = read_csv(spark, path) if ext == ".csv" else clean_headers(spark.read.parquet(path))
    except Exception as exc:  # surface one error type to callers
        raise ValueError(f"Could not read file: {exc}") from exc
    return coerce_date_columns(df) if coerce_dates else df


def clean_headers(df: DataFrame) -> DataFrame:
    """A4: strip names and make them unique (``a``, ``a.1``, ...), as Spark needs."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = str(c).strip()
        name = base
        while name.lower() in seen:
            seen[base.lower()] = seen.get(base.lower(), 0) + 1
            name = f"{base}.{seen[base.lower()]}"
        seen.setdefault(name.lower(), 0)
        names.append(name)
    return df.toDF(*names) if names != list(df.columns) else df


def date_candidates(df: DataFrame) -> list[str]:
    keys = SEMANTIC_KEYWORDS["date"]
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and any(k in f.name.lower() for k in keys)]


def date_coercion_table(df: DataFrame) -> DataFrame:
    """A5 decision as a table: (column, non_null, parsed, convert).

    All-or-nothing per column: converted only when every non-null value parses.
    One aggregate serves all candidate columns.
    """
    cands = date_candidates(df)
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint, parsed bigint, convert boolean")
    aggs = []
    for c in cands:
        aggs += [F.count(F.col(c)).alias(f"n{len(aggs)}"),
                 F.count(F.col(c).try_cast("timestamp_ntz")).alias(f"n{len(aggs) + 1}")]
    one = df.agg(*aggs)
    out = rows_of(one, [[F.lit(c), F.col(f"n{2 * i}"), F.col(f"n{2 * i + 1}")] for i, c in enumerate(cands)],
                  ["column", "non_null", "parsed"])
    return out.withColumn("convert", F.col("non_null") == F.col("parsed"))


# Date formats tried in this order, after what a cast takes (ISO): pattern, and the shape that a value must have to be
# parsed at all (a parse that fails is dear). Month first, as the analysed application reads slashes.
DATE_FORMATS = [
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("d/M/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Z][a-z]{2} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
]
ISO = "ISO"


def parse_date(column, fmt: str):
    """The text column as wall-clock timestamps in one format; what does not parse is NULL."""
    if fmt == ISO:
        return column.try_cast("timestamp_ntz")
    shape = dict(DATE_FORMATS)[fmt]
    return F.when(column.rlike(shape), F.try_to_timestamp(column, F.lit(fmt)).cast("timestamp_ntz"))


def date_format_table(df: DataFrame) -> DataFrame:
    """A5 with formats, as a table: (column, non_null, format) for the text columns whose name speaks of a date.

    ``format`` is the first one that parses every value of the column, NULL if none does; a column without
    values counts as ISO. A value's formats are a bit mask, and the masks of all values meet by a
    bit-and, so one aggregate over the table, with partial masks in the tasks, serves all columns.
    """
    cands = date_candidates(df)
    if not cands:
        return df.sparkSession.createDataFrame([], "column string, non_null bigint, format string")
    names = [ISO, *[f for f, _ in DATE_FORMATS]]
    # a column is trimmed once; a cast takes spaces around a date, the formats do not
    texts = df.select(*[F.trim(F.col(q(c))).alias(f"x{i}") for i, c in enumerate(cands)])

    def mask(x):
        iso = F.when(parse_date(x, ISO).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        return sum((F.when(parse_date(x, f).isNotNull(), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(names) if k), iso)

    aggs = [a for i in range(len(cands)) for x in [F.col(f"x{i}")]
            for a in (F.count(x).alias(f"n{i}"), F.bit_and(F.when(x.isNotNull(), mask(x))).alias(f"m{i}"))]
    rows = [[F.lit(c), F.col(f"n{i}"), F.coalesce(F.col(f"m{i}"), F.lit(1))] for i, c in enumerate(cands)]
    found = rows_of(texts.agg(*aggs), rows, ["column", "non_null", "mask"])
    first = F.coalesce(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0, F.lit(f)) for k, f in enumerate(names)])
    return found.select("column", "non_null", first.alias("format"))


def coerce_date_columns(df: DataFrame) -> DataFrame:
    """A5: parse the name-matched text columns whose values all have one format (see :func:`date_format_table`)."""
    if not date_candidates(df):
        return df
    formats = {r["column"]: r["format"] for r in date_format_table(df).collect() if r["format"]}  # a row a column
    return df.select(*[parse_date(F.trim(F.col(q(c))), formats[c]).alias(c) if c in formats else F.col(q(c)) for c in df.columns])


def sample_catalog(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Name -> path for the bundled tables that the session's file system holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {f.getPath().getName() for f in files.listStatus(folder)}
    return {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TEST_TABLES if f"{t}.parquet" in held}
