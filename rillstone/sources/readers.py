"""Readers of landed files. Schemas are given, fields that are missing become null, other fields are dropped.

``json_array`` and ``json_lines`` are Spark's own readers, which make nulls of what they can't parse. ``landed_lines`` and
``landed_arrays`` with ``checked`` keep the text of every record and say what is wrong with it.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files that hold one JSON array each; a file is read by one task. The schema is inferred only without one."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def frozen_schema(spark: SparkSession, path: str, fmt: str = "json", **options) -> T.StructType:
    """The schema inferred once from sample files, to be kept in code and used by all later reads."""
    return spark.read.options(**options).format(fmt).load(path).schema


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """A JSON object a line: splittable."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def landed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, raw: the lines of text files as they are, but for blank ones; splittable."""
    return _raw(spark.read.text(path))


def landed_arrays(spark: SparkSession, path: str | list[str], by_line: bool = False) -> DataFrame:
    """file, raw: the elements of files that hold a JSON array each, as JSON without the spaces between. A file that holds none, as one
    that is cut off, is one row: its whole text, as it is. A file is read by one task. With ``by_line`` the same holds of every line
    of the files, which are then splittable."""
    files = _raw(spark.read.option("wholetext", not by_line).text(path))
    whole = F.from_json("raw", "array<string>", {"mode": "PERMISSIVE"})
    listed = F.when(F.regexp_like("raw", F.lit(r"^\s*+\[")) & F.try_parse_json("raw").isNotNull(), whole)
    return files.select("file", F.explode(F.coalesce(listed, F.array("raw"))).alias("raw"))


def _raw(text: DataFrame) -> DataFrame:
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")).filter(F.regexp_like("raw", F.lit(r"\S")))


def checked(landed: DataFrame, schema: T.StructType) -> DataFrame:
    """file, raw, reason and the fields of the schema. The reason is null for a good record; else it is ``not_json``, ``not_an_object`` or
    ``bad_field: ...`` with the fields whose value doesn't fit their type, and the fields that could be read are kept."""
    broken = "__broken"
    whole = T.StructType([*schema, T.StructField(broken, T.StringType())])
    parsed = landed.select("file", "raw", F.from_json("raw", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}).alias("r"), F.try_parse_json(F.concat(F.lit("["), "raw", F.lit("]"))).alias("v"))  # as a list, for what follows a record would be passed over
    lost = [F.when(F.get_json_object("raw", f"$['{f.name}']").isNotNull() & F.col(f"r.`{f.name}`").isNull(), F.lit(f.name)) for f in schema]
    kind = F.substring(F.ltrim("raw"), 1, 1)
    reason = (
        F.when(F.col("v").isNull() | F.try_variant_get("v", "$[1]", "variant").isNotNull(), "not_json").when(kind != "{", "not_an_object")
        .when(F.col(f"r.{broken}").isNotNull(), F.concat(F.lit("bad_field: "), F.concat_ws(",", *lost)))
    )
    return parsed.select("file", "raw", reason.alias("reason"), *[F.col(f"r.`{f.name}`").alias(f.name) for f in schema])


def tree(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """All files under a folder, however deep, with the file each row came from."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).format(fmt).load(path).withColumn("file", F.col("_metadata.file_path"))


def csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", comment: str | None = None, header: bool = True) -> DataFrame:
    """CSV; lines that start with comment are skipped. Read wide files as text: types differ from column to column."""
    reader = spark.read.schema(schema).option("header", header).option("sep", sep)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def text_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzipped text (column value)."""
    return spark.read.text(path)


def over_path(spark: SparkSession, fmt: str, path: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {fmt}.`{path}`")


def archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """Zip files as rows (path, content), found at any depth; Spark leaves out files without a byte."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def unzip_lines(files: DataFrame, suffix: str = ".csv", encoding: str = "latin-1") -> DataFrame:
    """(path, content) -> path, member, n, line, reason of every member with the suffix. Lines are streamed out of a member
    in batches; this is the one step that needs Python. A file that is no archive gives one row with a reason, and so does a
    member that can't be read to its end, after the lines found in it; neither stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content.as_py() or b""))
                except zipfile.BadZipFile:
                    yield _batch([(path, None, None, None, "no archive")])
                    continue
                for name in sorted(x for x in z.namelist() if x.lower().endswith(suffix)):
                    held: list[tuple] = []
                    try:
                        with z.open(name) as f:
                            for n, line in enumerate(io.TextIOWrapper(f, encoding)):
                                held.append((path, name, n, line.rstrip("\r\n"), None))
                                if len(held) == 10_000:
                                    yield _batch(held)
                                    held = []
                    except (zipfile.BadZipFile, zlib.error, EOFError, UnicodeDecodeError, NotImplementedError, RuntimeError) as e:  # damaged, packed in an unknown way, or locked
                        held.append((path, name, None, None, f"unreadable: {type(e).__name__}"))
                    yield _batch(held)

    return files.select("path", "content").mapInArrow(run, "path string, member string, n long, line string, reason string")


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    columns = zip(*rows) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["path", "member", "n", "line", "reason"])


def after_header(lines: DataFrame, starts: str, columns: Sequence[str], sep: str = ";") -> DataFrame:
    """The lines below a member's header (its first line that starts so), as text columns found by the header's names.
    Members without a header, or with a reason not to trust them, give nothing; columns that a header lacks are null."""
    heads = (
        lines.filter(F.col("line").startswith(starts) | F.col("reason").isNotNull())
        .groupBy("path", "member")
        .agg(F.min(F.when(F.col("reason").isNull(), F.struct("n", "line"))).alias("h"), F.max("reason").alias("reason"))
        .filter("reason is null and h is not null")
        .select("path", "member", F.col("h.n").alias("h_n"), F.split("h.line", sep).alias("names"))
    )
    rows = lines.join(heads, ["path", "member"]).filter("n > h_n and trim(line) <> ''").withColumn("cells", F.split("line", sep, -1))
    return rows.select("path", "member", *[F.get("cells", (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in columns])


def stats(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, size, modified of all files under a folder, however deep; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def unread(spark: SparkSession, files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows of files (with column file) whose file isn't in the ledger yet."""
    return files.join(ledger.select("file"), "file", "left_anti")


def stations(inventory: DataFrame, code: str = "codigoestacao") -> DataFrame:
    """Distinct codes that are whole numbers."""
    return inventory.select(F.col(code).cast("string").try_cast("int").alias(code)).filter(F.col(code).isNotNull()).distinct()
