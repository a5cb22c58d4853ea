"""Names and keys of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a null id counts as in comparisons.
LAST = (1 << 63) - 1


def row_key(df: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """A row's id and the 128 bits that tell rows of one id (or of none) apart by their texts.

    Rows with the same id and text are alike in all that an operator finds, so they may share a key.
    """
    nil, text = F.col(id_col).isNull(), F.col(text_col)
    return {
        "doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)),
        "t1": F.xxhash64(nil, text),
        "t2": F.xxhash64(F.lit(1), text, nil),
    }


KEY = ["doc", "t1", "t2"]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names the result needs."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def schema_of(df: DataFrame, *more: str) -> str:
    """The schema as text, with further fields."""
    own = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*own, *more])
