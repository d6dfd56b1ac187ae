"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _writer(df: DataFrame, mode: str, compression: str | None, files: int | None):
    w = (df if files is None else df.coalesce(files)).write.mode(mode)
    return w if compression is None else w.option("compression", compression)


def write_json(df: DataFrame, path: str, compression: str | None = None, files: int | None = None, mode: str = "error") -> None:
    """JSON lines; `files` merges partitions without a shuffle; compression: bzip2, gzip, snappy, ..."""
    _writer(df, mode, compression, files).json(path)


def write_tsv(df: DataFrame, path: str, compression: str | None = None, files: int | None = None, mode: str = "error") -> None:
    _writer(df, mode, compression, files).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def key_value(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(value): the columns as text between tabs; arrays between blanks; nulls are left out. key: columns that come first."""
    columns = [*(key or []), *(c for c in df.columns if c not in (key or []))]
    text = [F.array_join(F.transform(c, lambda x: x.cast("string")), " ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string") for c in columns]
    return df.select(F.concat_ws("\t", *text).alias("value"))


def write_text(df: DataFrame, path: str, key: list[str] | None = None, compression: str | None = None, mode: str = "error") -> None:
    _writer(key_value(df, key), mode, compression, None).text(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet: for dictionaries, vectors and everything that is read again."""
    df.write.mode(mode).parquet(path)


def document_blocks(df: DataFrame, prefix: str, key: str = "page_id", title: str = "title", text: str = "text") -> DataFrame:
    """(value): <doc id url title> blocks with the text between."""
    head = F.concat(F.lit('<doc id="'), F.col(key).cast("string"), F.lit(f'" url="{prefix}?curid='), F.col(key).cast("string"), F.lit('" title="'), F.replace(F.col(title), F.lit('"'), F.lit("&quot;")), F.lit('">\n'))
    return df.select(F.concat(head, F.col(text), F.lit("\n</doc>")).alias("value"))


def write_documents(df: DataFrame, path: str, prefix: str, records_per_file: int = 10_000, compression: str | None = None, mode: str = "error") -> None:
    """Document blocks, in files of at most so many."""
    _writer(document_blocks(df, prefix), mode, compression, None).option("maxRecordsPerFile", records_per_file).text(path)
