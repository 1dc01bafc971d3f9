"""Tables as CSV and JSON, where every CSV cell is a string.

The reader and writer options make the round trip lossless: quotes are doubled, line
ends and blanks inside cells stay, nothing is typed and nothing trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "inferSchema": "false",
}
COLUMN = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header; all columns are strings, empty cells are empty strings.

    Raises ValueError if there is a header only.
    """
    raw = spark.read.options(**CSV).csv(path)
    filled = raw.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in raw.columns])
    if filled.isEmpty():
        raise ValueError("DECODE_FAILED: no rows below the header")
    return filled


def write_csv(df: DataFrame, path: str) -> None:
    as_strings(df).write.mode("overwrite").options(**CSV, emptyValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def as_strings(df: DataFrame) -> DataFrame:
    """Cells as CSV shows them: nulls are empty, nested values are JSON."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    cell = lambda f: F.to_json(f"`{f.name}`") if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast("string")
    return df.select(*[F.coalesce(cell(f), F.lit("")).alias(f.name) for f in df.schema])


def row_csv(df: DataFrame, *keep: str) -> DataFrame:
    """The keep columns and line, the row as a line of CSV."""
    return df.select(*keep, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), COLUMN).alias("line"))


def parse_csv_row(line: Column, names: list[str]) -> Column:
    """A struct of strings from a line of CSV."""
    return F.from_csv(line, ", ".join(f"`{n}` string" for n in names), {**COLUMN, "multiLine": "true"})


def row_json(df: DataFrame, *keep: str) -> DataFrame:
    """The keep columns and object, the row as JSON with nulls kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(*keep, F.to_json(whole, {"ignoreNullFields": "false"}).alias("object"))


def json_problem(document: Column, strict: bool = True) -> Column:
    """Why a JSON text is no table, or null: it must be an array of objects with at least one.

    Without strict only the first element has to be an object.
    """
    kind = F.schema_of_variant(F.try_parse_json(document))
    items = F.from_json(document, "array<string>")
    is_object = lambda x: F.coalesce(F.trim(x).startswith("{"), F.lit(False))
    good = F.forall(items, is_object) if strict else is_object(F.get(items, 0))
    return (
        F.when(kind.isNull(), "DECODE_FAILED")
        .when(~kind.startswith("ARRAY<"), "UNSUPPORTED_INPUT")
        .when(F.coalesce(F.size(items), F.lit(0)) < 1, "UNSUPPORTED_INPUT")
        .when(~F.coalesce(good, F.lit(False)), "UNSUPPORTED_INPUT")
    )


def parse_json_rows(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A row for each object of the JSON array in column, with the named cells as strings."""
    fields = ", ".join(f"`{n}` string" for n in names)
    return df.select("*", F.inline(F.from_json(column, f"array<struct<{fields}>>")))
