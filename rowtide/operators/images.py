"""Change logs of many tables with their own keys and columns.

A log row has ``tbl, op, before, after, statement`` and its place; ``before`` and ``after`` are the row's images as text by column.
Keys are any columns of any types, named per table. Schema changes of a table cut the log into epochs: each row is given its
epoch once, its image is turned into the columns the table has in the end, and the last event of each key counts. Plans don't
grow with the number of schema changes, which are a small table that rows are joined to by table name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowtide.operators.changes import ROW_OPS
from rowtide.operators.joins import null_safe
from rowtide.operators.ordered import POSITION, keep_last
from rowtide.operators.schema import alter_steps, classify_statement, keep_ddl, spark_type
from rowtide.session import scratch_path

IMAGE_SCHEMA = (
    "file_no bigint, pos bigint, seq bigint, tbl string, op string, before map<string,string>, after map<string,string>, statement string"
)
_IMAGE_COLUMNS = ["file_no", "pos", "seq", "tbl", "op", "before", "after", "statement"]
_INFO = "tbl string, starts array<struct<file_no:bigint,pos:bigint,seq:bigint>>, reset int, keys array<array<string>>, names array<array<string>>, chains array<array<int>>"


class Field(NamedTuple):
    """A column at some time: ``origin`` stays the same when it is renamed or retyped, and is another if it is dropped and added again."""

    origin: int
    name: str
    kind: T.DataType


class History(NamedTuple):
    """Epochs of one table: their first places, their columns, and the first epoch of which anything is left."""

    starts: list[tuple[int, int, int]]
    columns: list[list[Field]]
    reset: int
    base: DataFrame | None  # rows the table has at the start of epoch ``reset``


def _steps(fields: list[Field], statement: str, free: int) -> tuple[list[Field], int]:
    """The columns after an ``alter table``."""
    for step in alter_steps(statement):
        at = {f.name.lower(): i for i, f in enumerate(fields)}
        here = at.get(step.column.lower())
        if step.action == "add":
            if here is not None:
                continue
            moved, free, fields = Field(free, step.column.lower(), spark_type(step.kind)), free + 1, list(fields)
        elif here is None:
            continue
        else:
            moved, fields = fields[here], [f for i, f in enumerate(fields) if i != here]
            if step.action == "drop":
                continue
            moved = moved._replace(kind=spark_type(step.kind)) if step.action == "retype" else moved._replace(name=step.new)
        names = [f.name.lower() for f in fields]
        place = len(fields) if here is None else here
        if step.after == "":
            place = 0
        elif step.after is not None and step.after.lower() in names:
            place = names.index(step.after.lower()) + 1
        fields = [*fields[:place], moved, *fields[place:]]
    return fields, free


def history(base: DataFrame, statements: list[tuple[tuple[int, int, int], str, str]], load: Callable[[], DataFrame] | None = None) -> History:
    """The epochs of a table that begins as ``base`` and sees ``statements`` (place, kind, text) in log order.

    Truncate and drop leave no rows. A create statement starts again from ``load()`` if given, else changes nothing.
    """
    fields = [Field(i, f.name, f.dataType) for i, f in enumerate(base.schema.fields)]
    free, starts, columns, reset, rows = len(fields), [], [fields], 0, base
    for place, kind, text in sorted(statements):
        if kind in ("TRUNCATE_TABLE", "DROP_TABLE"):
            reset, rows = len(columns), None
        elif kind == "CREATE_TABLE" and load:
            reset, rows = len(columns), load()
            fields = [Field(free + i, f.name, f.dataType) for i, f in enumerate(rows.schema.fields)]
            free += len(fields)
        elif kind != "CREATE_TABLE":
            fields, free = _steps(fields, text, free)
        starts.append(place)
        columns.append(fields)
    return History(starts, columns, reset, rows)


def _chain(h: History, epoch: int, origin: int) -> tuple[str | None, tuple[T.DataType, ...]]:
    """A column's name in an epoch, and the types its values go through up to the end; no name if it wasn't there yet."""
    name, kinds = None, []
    for fields in h.columns[epoch:]:
        for f in fields:
            if f.origin == origin:
                name = name or f.name
                kinds += [f.kind] if not kinds or kinds[-1] != f.kind else []
        if name is None:
            return None, ()
    return name, tuple(kinds)


def _cast(value: Column, kinds: tuple[T.DataType, ...]) -> Column:
    for kind in kinds:
        value = value.try_cast(kind)
    return value


class Table(NamedTuple):
    """How a table's rows are made: its history, its last columns and, for each, the chains of types that occur."""

    history: History
    fields: list[Field]
    chains: list[list[tuple[T.DataType, ...]]]
    keys: list[str]


def _table(h: History, keys: list[str]) -> tuple[Table, tuple]:
    """The table, and its row of the join table: by epoch the names of its keys and columns, and the chain of each column."""
    fields = h.columns[-1]
    by_name = {f.name.lower(): f for f in fields}
    chains: list[list[tuple[T.DataType, ...]]] = [[] for _ in fields]
    names, which, key_names = [], [], []
    for epoch in range(len(h.columns)):
        row = [_chain(h, epoch, f.origin) for f in fields]
        for i, (name, kinds) in enumerate(row):
            if name is not None and kinds not in chains[i]:
                chains[i].append(kinds)
        names.append([n for n, _ in row])
        which.append([chains[i].index(kinds) if n is not None else -1 for i, (n, kinds) in enumerate(row)])
        key_names.append([_chain(h, epoch, by_name[k.lower()].origin)[0] for k in keys])
    return Table(h, fields, chains, [by_name[k.lower()].name for k in keys]), (h.starts, h.reset, key_names, names, which)


def statements_of(changes: DataFrame) -> DataFrame:
    """(tbl, file_no, pos, seq, kind, statement): schema statements with the table they are about, in lower case.

    The schema is the one written in the statement, else the one the event was logged under.
    """
    named = classify_statement(keep_ddl(changes.filter("op = 'query'")))
    plain = F.regexp_replace(F.regexp_replace("statement", "`", ""), r"\s+", " ")
    full = F.regexp_extract(plain, r"(?i)\btable (?:if (?:not )?exists )?([^\s(;]+)", 1)
    of = F.when(F.contains(full, F.lit(".")), full).otherwise(F.concat_ws(".", F.nullif(F.substring_index("tbl", ".", 1), F.lit("")), full))
    return named.select(F.lower(of).alias("tbl"), *POSITION, F.col("op").alias("kind"), "statement")


def tables_of(
    targets: Mapping[str, DataFrame], statements: DataFrame, keys: Mapping[str, list[str]], load: Callable[[str], DataFrame] | None = None
) -> tuple[dict[str, Table], DataFrame]:
    """What is known of the tables at the end of the log, and the table that events are joined to. Statements are collected, rows never."""
    made = {t: _table(h, keys[t]) for t, h in _histories(targets, statements, load).items()}
    return {t: table for t, (table, _) in made.items()}, _info(statements, made)


def known_tables(
    targets: Mapping[str, DataFrame], statements: DataFrame, keys: Mapping[str, list[str]], load: Callable[[str], DataFrame] | None = None
) -> tuple[DataFrame, list[str]]:
    """The table that events are joined to while not all statements are there, and the tables that lack a key column so far."""
    told = _histories(targets, statements, load)
    lacking = [t for t, h in told.items() if not {k.lower() for k in keys[t]} <= {f.name.lower() for f in h.columns[-1]}]
    return _info(statements, {t: _table(h, keys[t]) for t, h in told.items() if t not in lacking}), lacking


def _histories(targets: Mapping[str, DataFrame], statements: DataFrame, load: Callable[[str], DataFrame] | None) -> dict[str, History]:
    names = {t.lower(): t for t in targets}
    said: dict[str, list] = {t: [] for t in targets}
    for r in statements.filter(F.col("tbl").isin(*names)).collect():
        said[names[r["tbl"]]].append(((r["file_no"], r["pos"], r["seq"]), r["kind"], r["statement"]))
    return {t: history(df, said[t], (lambda t=t: load(t)) if load else None) for t, df in targets.items()}


def _info(statements: DataFrame, made: Mapping[str, tuple[Table, tuple]]) -> DataFrame:
    return statements.sparkSession.createDataFrame([(t, *row) for t, (_, row) in made.items()], _INFO)


def _keyed(changes: DataFrame, info: DataFrame, compat: bool, kept: Callable[[Column], Column]) -> DataFrame:
    """The last event of each key, as (tbl, key, deleted, image, epoch, place); a key that an update leaves is deleted.

    Of an image only what ``kept`` makes of it goes on. Events are dealt out by place in parts of the advisory size before each
    part is reduced to its last events, so that a task sorts as much as that, however large its part of the log's files is. What
    is the same for all rows of a table stays in ``info``.
    """
    place = F.struct(*[F.col(c) for c in POSITION])
    epoch = F.size(F.filter("starts", lambda s: s < place))
    rows = changes.filter(F.col("op").isin(*ROW_OPS)).join(F.broadcast(info), "tbl").withColumn("epoch", epoch).filter("epoch >= reset")

    def key(image: str) -> Column:
        return F.transform(F.element_at("keys", F.col("epoch") + 1), lambda n: F.element_at(image, n))

    before, after = kept(F.col("before")).alias("image"), kept(F.col("after")).alias("image")
    own = F.when(F.col("op") == "delete", F.struct(key("before").alias("key"), F.lit(True).alias("deleted"), before))
    own = own.otherwise(F.struct(key("after").alias("key"), F.lit(False).alias("deleted"), after))
    old = F.struct(key("before").alias("key"), F.lit(True).alias("deleted"), before)
    moved = (F.col("op") == "update") & ~key("before").eqNullSafe(key("after")) & F.lit(not compat)
    flat = rows.select("tbl", "epoch", *POSITION, F.explode(F.when(moved, F.array(old, own)).otherwise(F.array(own))).alias("_e"))
    flat = flat.select("tbl", "_e.*", "epoch", *POSITION).hint("rebalance", *[F.col(c) for c in POSITION])
    return keep_last(flat, ["tbl", "key"], POSITION)


def net_images(changes: DataFrame, info: DataFrame, compat: bool = False) -> DataFrame:
    """The last event of each key of every table: (tbl, key, deleted, values, chains, place); values are those of the last columns."""
    at = F.col("epoch") + 1
    last = _keyed(changes, info, compat, lambda image: F.transform(F.element_at("names", at), lambda n: F.element_at(image, n)))
    last = last.join(F.broadcast(info.select("tbl", F.col("chains").alias("_chains"))), "tbl")
    return last.select("tbl", "key", "deleted", F.col("image").alias("values"), F.element_at("_chains", at).alias("chains"), *POSITION)


def reduced_log(changes: DataFrame, info: DataFrame, compat: bool = False, whole: Sequence[str] = ()) -> DataFrame:
    """A shorter log with the same effect: one insert or delete for each key, all events of the tables ``whole``, and all statements."""
    none = F.lit(None).cast("map<string,string>")
    last = _keyed(changes, info, compat, lambda image: image).select(
        *POSITION, "tbl", F.when(F.col("deleted"), "delete").otherwise("insert").alias("op"), F.when(F.col("deleted"), F.col("image")).otherwise(none).alias("before"),
        F.when(~F.col("deleted"), F.col("image")).otherwise(none).alias("after"), F.lit(None).cast("string").alias("statement"),
    )
    return last.select(*_IMAGE_COLUMNS).unionByName(changes.filter((F.col("op") == "query") | (F.col("op").isin(*ROW_OPS) & F.col("tbl").isin(*whole))).select(*_IMAGE_COLUMNS))


def _typed(value: Column, chain: Column, chains: list[tuple[T.DataType, ...]], kind: T.DataType) -> Column:
    """A value's text as the last type, through the types its column had; one branch for each chain that occurs."""
    out = F.lit(None).cast(kind)
    for k, kinds in enumerate(chains):
        out = F.when(chain == k, _cast(value, kinds)).otherwise(out)
    return out


def apply_images(table: Table, net: DataFrame) -> DataFrame:
    """A table's rows after its part of :func:`net_images`; touched keys leave, live images come in."""
    h, fields = table.history, table.fields
    made = [_typed(F.col("values")[i], F.col("chains")[i], table.chains[i], f.kind).alias(f.name) for i, f in enumerate(fields)]
    live = net.filter("not deleted").select(*made)
    if h.base is None:
        return live
    now = []
    for f in fields:
        name, kinds = _chain(h, h.reset, f.origin)
        now.append((_cast(F.col(f"`{name}`"), kinds[1:]) if name else F.lit(None).cast(f.kind)).alias(f.name))
    rows = h.base.select(*now)
    kinds = {f.name: f.kind for f in fields}
    gone = net.select(*[F.col("key")[i].try_cast(kinds[k]).alias(k) for i, k in enumerate(table.keys)])
    return rows.join(gone, null_safe(rows, gone, table.keys), "left_anti").unionByName(live)


def route_tables(
    targets: Mapping[str, DataFrame], changes: DataFrame, keys: Mapping[str, list[str]], load: Callable[[str], DataFrame] | None = None, compat: bool = False
) -> dict[str, DataFrame]:
    """Every table after the row changes and schema changes of one log, in log order whatever order rows come in.

    ``targets`` are the tables as they were before the log, ``keys`` their key columns, both by the table's last names. The log
    is read once for the statements and once for the rows, however many statements or tables there are: the last
    events are written to the shared folder by table, and each table reads its own.
    """
    spark: SparkSession = changes.sparkSession
    tables, info = tables_of(targets, statements_of(changes), keys, load)
    place = scratch_path(spark, "net-images")
    net = net_images(changes, info, compat)
    net.write.partitionBy("tbl").parquet(place)
    kept = spark.read.schema(T.StructType([*net.drop("tbl").schema.fields, T.StructField("tbl", T.StringType())])).parquet(place)
    return {t: apply_images(table, kept.filter(F.col("tbl") == t)) for t, table in tables.items()}
