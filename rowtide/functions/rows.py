"""Keys, fingerprints and value normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def key_string(keys: list[str], sep: str = "^^^") -> Column:
    """The key as one text, for display; joins use the key columns themselves."""
    return F.concat_ws(sep, *[F.col(k).cast("string") for k in keys])


def map_table_name(name: Column) -> Column:
    """``schema.table`` as ``schema_table``."""
    return F.replace(name, F.lit("."), F.lit("_"))


def row_text(cols: list[str]) -> Column:
    """The row as comma-joined text, null as nothing."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


def row_fingerprint(cols: list[str]) -> Column:
    """MD5 of the row's text."""
    return F.md5(row_text(cols))


def marked_text(name: str) -> Column:
    """A value with its length in front, so that joined values can't run into each other; null has a mark of its own."""
    text = F.col(name).cast("string")
    return F.when(text.isNull(), F.lit("-;")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def row_hash(cols: list[str]) -> Column:
    """64-bit hash of a row that also tells where its nulls are (the plain hash skips them)."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return F.xxhash64(*cols, nulls)


def add_constants(df: DataFrame, constants: dict[str, str], keys: list[str]) -> DataFrame:
    """Constant text columns; ``$PK$`` stands for the key values joined by '_'."""
    pk = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    for name, value in constants.items():
        text = F.replace(F.lit(value), F.lit("$PK$"), pk) if "$PK$" in value else F.lit(value)
        df = df.withColumn(name, text)
    return df


def normalise_values(df: DataFrame, rowversion: list[str] | None = None) -> DataFrame:
    """Times cut to seconds, booleans as 1/0, row versions as null."""
    out = []
    for f in df.schema.fields:
        col = F.col(f.name)
        if f.name in (rowversion or []):
            col = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_trunc("second", col).cast(f.dataType)
        elif isinstance(f.dataType, T.BooleanType):
            col = col.cast("int")
        out.append(col.alias(f.name))
    return df.select(*out)


def keys_first(df: DataFrame, keys: list[str], constants: dict[str, str] | None = None) -> DataFrame:
    """Key columns first, then the rest in source order, then constant columns."""
    rest = [c for c in df.columns if c not in keys]
    return add_constants(df.select(*keys, *rest), constants or {}, keys)
