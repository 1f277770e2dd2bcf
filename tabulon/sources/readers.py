"""Readers for delimited text, JSON, parquet and JDBC, chosen by file suffix."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tabulon.errors import UnsupportedFormatError
from tabulon.functions.text import NULL_TOKENS
from tabulon.operators.clean import normalize_nulls

# Candidate delimiters in order of preference, wrapper keys in order of preference.
DELIMITERS = (",", ";", "\t", "|")
WRAPPERS = ("data", "records", "items")
BAD = "_bad_line"


def detect_delimiter(spark: SparkSession, path: str, lines: int = 5) -> str:
    """The candidate that occurs most often in the first lines; a comma when none does."""
    head = [r[0] for r in spark.read.text(path).filter(F.length("value") > 0).limit(lines).collect()]
    counts = {d: sum(line.count(d) for line in head) for d in DELIMITERS}
    best = max(DELIMITERS, key=counts.__getitem__)
    return best if counts[best] else ","


def _csv_rows(spark: SparkSession, path: str, delimiter: str | None, encoding: str) -> tuple[DataFrame, str]:
    sep = delimiter or detect_delimiter(spark, path)
    # Which lines are bad must not depend on the columns a query happens to use.
    options = dict(sep=sep, encoding=encoding, quote='"', escape="\\", header=True)
    names = spark.read.csv(path, **options).schema
    schema = StructType([*names.fields]).add(BAD, "string")
    reader = spark.read.schema(schema).option("columnPruning", False)
    return reader.csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, **options), sep


def _too_long(sep: str, columns: int):
    """True for lines with more fields than the header; short lines are filled with nulls."""
    bare = F.regexp_replace(F.col(BAD), r'"([^"\\]|\\.)*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    return F.col(BAD).isNotNull() & (fields > columns)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; lines with too many fields are skipped."""
    rows, sep = _csv_rows(spark, path, delimiter, encoding)
    return rows.filter(~_too_long(sep, len(rows.columns) - 1)).drop(BAD)


def csv_report(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Delimiter, kept rows and skipped rows of a file."""
    rows, sep = _csv_rows(spark, path, delimiter, encoding)
    skip = _too_long(sep, len(rows.columns) - 1)
    # The bad-line column cannot be scanned alone, so the counts read the first data column too.
    used = rows.select(F.col(f"`{rows.columns[0]}`").alias("first"), skip.alias("skip"))
    return used.agg(
        F.lit(sep).alias("delimiter"),
        F.count_if(~F.col("skip")).alias("row_count"),
        F.count_if("skip").alias("skipped_rows"),
        F.count("first").alias("first_column_filled"),
    )


def read_json(spark: SparkSession, path: str, flat: bool = True, lines: bool = False) -> DataFrame:
    """A list of objects, an object around such a list, one object, or scalars as `value` rows."""
    rows = spark.read.json(path, multiLine=not lines, columnNameOfCorruptRecord=BAD)
    if rows.columns == [BAD]:
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", "array<string>")).alias("value"))
    elif not lines and _opens_with_object(spark, path):
        rows = unwrap(rows)
    return flatten(rows) if flat else rows


def _opens_with_object(spark: SparkSession, path: str) -> bool:
    """Whether the document is one object, which may wrap a list, and not a list itself."""
    head = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    first = head.select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    return first is not None and first["c"] == "{"


def unwrap(rows: DataFrame) -> DataFrame:
    """Explode the list under the first wrapper key that holds one."""
    for key in WRAPPERS:
        if key in rows.columns and isinstance(rows.schema[key].dataType, ArrayType):
            inner = rows.schema[key].dataType.elementType
            items = rows.select(F.explode(F.col(f"`{key}`")).alias("value"))
            return items.select("value.*") if isinstance(inner, StructType) else items
    return rows


def flatten(rows: DataFrame) -> DataFrame:
    """Structs become a.b columns, lists of structs a[0].b, lists of scalars JSON text."""
    while True:
        lists = [
            f.name
            for f in rows.schema
            if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)
        ]
        structs = [f.name for f in rows.schema if isinstance(f.dataType, StructType)]
        if not lists and not structs:
            break
        sizes: Mapping[str, int] = {}
        if lists:
            longest = rows.agg(*[F.coalesce(F.max(F.size(F.col(f"`{c}`"))), F.lit(0)).alias(c) for c in lists]).first()
            sizes = {c: max(0, longest[c]) for c in lists}
        out = []
        for f in rows.schema:
            column = F.col(f"`{f.name}`")
            if f.name in structs:
                out += [column.getField(k).alias(f"{f.name}.{k}") for k in f.dataType.fieldNames()]
            elif f.name in lists:
                for i in range(sizes[f.name]):
                    item = F.get(column, F.lit(i))
                    out += [item.getField(k).alias(f"{f.name}[{i}].{k}") for k in f.dataType.elementType.fieldNames()]
            else:
                out.append(column)
        rows = rows.select(*out)
    return rows.select(
        *[
            F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`")
            for f in rows.schema
        ]
    )


def extract_path(rows: DataFrame, column: str, path: str, schema: str | None = None) -> DataFrame:
    """Items under a dotted path of a JSON text column: a list gives rows, an object one, a miss none."""
    found = F.get_json_object(F.col(f"`{column}`"), "$" + "".join(f".{p}" for p in path.split(".") if p))
    others = [F.col(f"`{c}`") for c in rows.columns if c != column]
    items = F.when(found.startswith("["), F.from_json(found, "array<string>")).otherwise(F.array(found))
    out = rows.select(*others, found.alias("_found"), items.alias("_items")).filter(F.col("_found").isNotNull())
    out = out.select(*others, F.explode("_items").alias("item"))
    if schema is None:
        return out
    return out.select(*others, F.from_json("item", schema).alias("item")).select(*others, "item.*")


def read_parquet(spark: SparkSession, path: str, tokens=NULL_TOKENS) -> DataFrame:
    """Parquet with null tokens in text columns as nulls."""
    return normalize_nulls(spark.read.parquet(path), tokens)


def jdbc_options(
    url: str, query: str, limit: int | None = None, partition: tuple[str, int, int, int] | None = None, **options
) -> dict[str, str]:
    """Reader options of one query; partition is (column, lower, upper, parts) for parallel reads."""
    text = query.strip().rstrip(";")
    if limit is not None:
        text = f"SELECT * FROM ({text}) limited LIMIT {int(limit)}"
    out = {"url": url, **{k: str(v) for k, v in options.items()}}
    if partition is None:
        return {**out, "query": text}
    column, lower, upper, parts = partition
    return {
        **out,
        "dbtable": f"({text}) source",
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(parts),
    }


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """A query against PostgreSQL, MySQL or any database whose driver is on the class path."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **options)).load()


READERS = {
    ".csv": read_csv,
    ".tsv": lambda spark, path, **o: read_csv(spark, path, delimiter="\t", **o),
    ".json": read_json,
    ".jsonl": lambda spark, path, **o: read_json(spark, path, lines=True, **o),
    ".parquet": read_parquet,
}


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file suffix for any path the file system knows, object stores included."""
    name = path.rstrip("/").lower().split("/")[-1]
    for suffix, reader in READERS.items():
        if name.endswith(suffix):
            return reader(spark, path, **options)
    raise UnsupportedFormatError(f"no reader for {path}")
