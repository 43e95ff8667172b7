"""Names for rows and columns that no input can clash with."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_keys(key: str, text: str) -> list[Column]:
    """96 bits that name a row by its id and text; repeated rows share them, and their result."""
    return [
        F.xxhash64(F.col(key), F.col(text)).alias("_row"),
        F.hash(F.col(text), F.col(key), F.lit(5)).alias("_check"),
    ]


def numbered_columns(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed by place, and the new name of each."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))
