"""Reading files by suffix, with sniffing of separators and encodings from a file's head, and a quarantine for rows that do not fit."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import stores

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

SEPARATORS = [",", ";", "\t", "|", ":"]
#: Suffixes of codecs that Hadoop reads on its own.
PACKED = (".gz", ".bz2", ".deflate")
#: Files up to this size are counted exactly; of larger ones that many ranges of SAMPLE bytes are looked at.
EXACT_BYTES, RANGES, SAMPLE = 1_000_000, 40, 50_000


@dataclass(frozen=True)
class Loaded:
    """A table, the lines of its file that did not fit as (file, line), and how many rows each has."""

    df: DataFrame
    rejected: DataFrame
    accepted_rows: int
    rejected_rows: int


def head(spark: SparkSession, path: str, size: int = 50_000) -> bytes:
    """The first bytes of a file, unpacked; of a folder, of its first file."""
    if stores.is_folder(spark, path):
        path = f"{path}/{next(n for n in stores.names_in(spark, path) if not n.startswith(('_', '.')))}"
    return stores.read_range(spark, path, 0, size)


def sniff_encoding(data: bytes) -> str:
    if data.startswith(b"\xef\xbb\xbf"):
        return "UTF-8"
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    for cut in range(4 if len(data) >= 50_000 else 1):  # a long head may end inside a character
        try:
            data[: len(data) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError:
            pass
    return "ISO-8859-1"


def sniff_separator(text: str) -> str:
    """Of the candidates, one with the same count in each of the first lines wins by that count, else by its least count."""
    lines = [x for x in text.splitlines() if x.strip()][:5]
    best, score = ",", 0
    for s in SEPARATORS:
        counts = [x.count(s) for x in lines]
        value = min(counts, default=0)
        if value > score:
            best, score = s, value
    return best


def csv_options(spark: SparkSession, path: str) -> dict[str, str]:
    data = head(spark, path)
    encoding = sniff_encoding(data)
    return {"header": "true", "sep": sniff_separator(data.decode(encoding, "replace")) if data else ",", "encoding": encoding}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file (packed too) with sniffed separator and encoding and inferred types. Lines of another width are cut or filled with nulls."""
    return spark.read.options(**csv_options(spark, path)).csv(path, inferSchema=True)


def read_checked(spark: SparkSession, path: str) -> Loaded:
    """A CSV file without the lines that do not fit: of another width than its header, or with quotes that do not close.

    All lines are parsed once, into a stored table, which both parts of the result read.
    """
    options = csv_options(spark, path)
    schema = spark.read.options(**options).csv(path, inferSchema=True).schema
    names = {f.name.lower() for f in schema}
    bad, file = (next(x for i in range(len(names) + 1) if (x := "_" * (i + 1) + n) not in names) for n in ("line", "file"))
    lines = spark.read.options(**options).schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=bad)
    parsed = stores.stored(lines.withColumn(file, F.col("_metadata.file_path")), "parsed")
    wrong = F.col(bad).isNotNull()
    n = parsed.agg(F.count(F.when(~wrong, 1)).alias("accepted"), F.count(F.when(wrong, 1)).alias("rejected")).first()
    return Loaded(parsed.where(~wrong).drop(bad, file), parsed.where(wrong).select(F.col(file).alias("file"), F.col(bad).alias("line")), n["accepted"], n["rejected"])


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns to columns with dotted names, at every depth."""
    out = []

    def walk(path: list[str], kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk([*path, f.name], f.dataType)
        else:
            out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records in an array, one record, or an object whose only key holds an array of records; nested objects are flattened."""
    df = spark.read.json(path, multiLine=True)
    if len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.ArrayType) and isinstance(df.schema[0].dataType.elementType, T.StructType):
        df = df.select(F.inline(df.columns[0]))
    return flatten(df)


def suffix(path: str) -> str:
    """The lower-case suffix that says how a file is read, without that of a codec."""
    name = PurePosixPath(path).name.lower()
    for end in PACKED:
        name = name.removesuffix(end)
    return PurePosixPath(name).suffix


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads by suffix: parquet (a folder without suffix too), csv and text tables (packed too), json, zip with a CSV. Rows of odd width are kept as far as they fit."""
    kind = suffix(path)
    if kind == ".parquet" or not kind and stores.is_folder(spark, path):
        return spark.read.parquet(path)
    if kind == ".json":
        return read_json(spark, path)
    if kind == ".zip":
        return read_zip(spark, path)
    if kind in (".xlsx", ".xls"):
        raise ValueError("Excel files need a reader that is not installed; export the sheet as CSV")
    return read_csv(spark, path)


def load_tolerant(spark: SparkSession, path: str) -> Loaded:
    """load() with a quarantine: the lines of a CSV file that do not fit are set apart and counted. Other formats have none."""
    if suffix(path) in (".csv", ".tsv", ".txt"):
        return read_checked(spark, path)
    df = load(spark, path)
    return Loaded(df, spark.createDataFrame([], "file string, line string"), df.count(), 0)


def load_strict(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A table and what is known of its file; raises for a file that is missing, of a suffix that is not known, or with lines that do not fit."""
    files, p = stores.hadoop(spark, path)
    if not files.exists(p):
        raise FileNotFoundError(path)
    kind = suffix(path)
    if kind not in (".csv", ".parquet", ".json", ".zip"):
        raise ValueError(f"a file of a kind that is not read: {kind or path}")
    loaded = load_tolerant(spark, path)
    if loaded.rejected_rows:
        raise ValueError(f"{loaded.rejected_rows} lines of {path} do not fit, the first: {loaded.rejected.first()['line']!r}")
    info = {"file_path": path, "file_size": stores.size_of(spark, path), "format": kind, "rows": loaded.accepted_rows, "columns": len(loaded.df.columns), "column_names": loaded.df.columns}
    if kind == ".csv":
        options = csv_options(spark, path)
        info |= {"encoding": options["encoding"], "separator": options["sep"]}
    return loaded.df, info


def estimated_rows(spark: SparkSession, path: str, ranges: int = RANGES, sample: int = SAMPLE) -> int:
    """Rows of a text file below its header: exact up to EXACT_BYTES and for packed files, else from the line ends in evenly spaced ranges of bytes."""
    size = stores.size_of(spark, path)
    if size <= EXACT_BYTES or path.lower().endswith(PACKED) or stores.is_folder(spark, path):
        return max(0, spark.read.text(path).count() - 1)
    step = size // ranges
    looked = [stores.read_range(spark, path, i * step, min(sample, step)) for i in range(ranges)]
    seen = sum(map(len, looked))
    return max(0, round(size / seen * sum(x.count(b"\n") for x in looked)) - 1)


def typed(df: DataFrame) -> DataFrame:
    """Text columns all of whose values are whole numbers, numbers, truth words or times, as columns of that type. One aggregate decides for all columns."""
    texts = [c for c, k in df.dtypes if k == "string"]
    kinds = ["bigint", "double", "boolean", "timestamp"]

    def parsed(c: str, kind: str) -> Column:
        x = F.trim(F.col(f"`{c}`"))
        x = F.when(x != "", x)
        if kind == "boolean":
            return F.when(F.lower(x).isin("true", "false"), F.lower(x) == "true")
        plain = x.rlike(r"^[+-]?\d+$") if kind == "bigint" else x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") if kind == "double" else x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}")
        return F.when(plain, x.try_cast(kind))

    if not texts:
        return df
    filled = lambda c: F.count(F.when(F.trim(F.col(f"`{c}`")) != "", 1))
    n = df.agg(*[F.struct(filled(c).alias("all"), *[F.count(parsed(c, k)).alias(k) for k in kinds]).alias(f"_{i}") for i, c in enumerate(texts)]).first()
    found = {c: next((k for k in kinds if n[i]["all"] and n[i][k] == n[i]["all"]), None) for i, c in enumerate(texts)}
    return df.withColumns({c: parsed(c, k) for c, k in found.items() if k})


def read_zip(spark: SparkSession, path: str, most_rows: int = 5000) -> DataFrame:
    """The first CSV of an archive, types inferred. A zip cannot be split: one task reads it, some rows at a time.

    The header is told by its place. Rows of another width are cut or filled with nulls.
    """

    def rows(batches):
        import csv
        import io
        import zipfile
        from itertools import batched

        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                    if name is None:
                        raise ValueError("the archive holds no CSV")
                    with z.open(name) as f:
                        start = f.read(50_000)
                    encoding = sniff_encoding(start)
                    sep = sniff_separator(start.decode(encoding, "replace"))
                    with z.open(name) as f:
                        text = io.TextIOWrapper(f, "utf-8-sig" if encoding == "UTF-8" else encoding, errors="replace", newline="")
                        for part in batched(enumerate(line for line in csv.reader(text, delimiter=sep) if line), most_rows):
                            yield pd.DataFrame({"n": [n for n, _ in part], "cells": [c for _, c in part]})

    table = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "n long, cells array<string>")
    table = stores.stored(table, "unpacked")
    first = table.where("n = 0").first()
    if first is None:
        raise ValueError(f"the CSV in {path} is empty")
    body = table.where("n > 0").select(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(first["cells"])])
    return typed(body)
