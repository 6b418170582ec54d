"""Ordered change logs (X3-X8, X11-X15): net effect of a batch, positions, routing and rendering.

A log row has ``tbl, op, before_pk, pk``, the after image and its place ``(file_no, pos, seq)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowtide.operators.joins import null_safe
from rowtide.operators.ordered import POSITION, keep_last

ROW_OPS = ("insert", "update", "delete")
# fixed values: column types written without quotes
BARE_TYPES = ("tinyint", "int", "bigint", "float", "double", "decimal")


def dedupe_events(changes: DataFrame) -> DataFrame:
    """Each log place once, however often it was delivered."""
    return changes.dropDuplicates(POSITION)


def net_changes(changes: DataFrame, keys: list[str], images: list[str], before: str = "before_pk", pk: str = "pk", compat: bool = False) -> DataFrame:
    """The last event of every key as a live image or a tombstone (``deleted``).

    An update that changes the key also puts a tombstone on the old one; ``compat`` leaves the old row in place.
    The rank filter works before the shuffle too, so a hot key is reduced where it is read.
    """
    own = F.struct(F.col(pk).alias("_key"), (F.col("op") == "delete").alias("deleted"))
    old = F.struct(F.col(before).alias("_key"), F.lit(True).alias("deleted"))
    moved = (F.col("op") == "update") & ~F.col(before).eqNullSafe(F.col(pk)) & F.lit(not compat)
    touched = F.when(moved, F.array(old, own)).otherwise(F.array(own))
    others = [k for k in keys if k != pk]
    flat = changes.filter(F.col("op").isin(*ROW_OPS)).select(*others, F.explode(touched).alias("_t"), *images, *POSITION)
    flat = flat.select(*others, F.col("_t._key").alias(pk), "_t.deleted", *images, *POSITION)
    return keep_last(flat, keys, POSITION)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], images: list[str], compat: bool = False) -> DataFrame:
    """The target after a batch of changes: touched keys leave, live images come in."""
    last = net_changes(changes, keys, images, compat=compat)
    gone = last.select(*keys)
    kept = target.join(gone, null_safe(target, gone, keys), "left_anti")
    live = last.filter(~F.col("deleted")).select(*target.columns)
    return kept.select(*target.columns).unionByName(live)


def idempotent_insert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is already there count as applied; of several rows of a key the first by log place counts.

    Without a log place in ``rows``, the first by all other columns. Null keys are keys like others.
    """
    order = [c for c in POSITION if c in rows.columns] or [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    there = target.select(*keys)
    fresh = first.join(there, null_safe(first, there, keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def after_position(file_no: int | Column, pos: int | Column) -> Column:
    """True for events behind a log place; numbers are compared, not text."""
    f, p = (x if isinstance(x, Column) else F.lit(x) for x in (file_no, pos))
    return (F.col("file_no") > f) | ((F.col("file_no") == f) & (F.col("pos") > p))


def up_to_position(file_no: int, pos: int) -> Column:
    return ~after_position(file_no, pos)


def snapshot_then_changes(
    snapshot: DataFrame, taken_at: dict[str, tuple[int, int]], changes: DataFrame, keys: list[str], images: list[str]
) -> DataFrame:
    """A snapshot and the events behind the place at which each table's part was taken.

    Places belong to the job description, so they are a plain condition and the log is not shuffled by table.
    """
    covered = F.lit(False)
    for table, place in taken_at.items():
        covered = covered | ((F.col("tbl") == table) & up_to_position(*place))
    return apply_changes(snapshot, changes.filter(~covered), keys, images)


def catch_up(
    target: DataFrame, new_snapshot: DataFrame, known: list[str], changes: DataFrame,
    old: tuple[int, int], new: tuple[int, int], keys: list[str], images: list[str],
) -> DataFrame:
    """Known tables replay the events in (old, new]; tables added since come from the snapshot taken at ``new``."""
    replay = changes.filter(F.col("tbl").isin(*known) & after_position(*old) & up_to_position(*new))
    added = new_snapshot.filter(~F.col("tbl").isin(*known))
    return apply_changes(target, replay, keys, images).unionByName(added.select(*target.columns))


def resume_position(saved: DataFrame, files: DataFrame, end: DataFrame) -> DataFrame:
    """The saved place if its file is still there, else the current end with ``gap`` set.

    ``saved`` is (tag, file_no, pos), ``files`` (file_no), ``end`` one row (end_file, end_pos).
    """
    there = files.select("file_no").distinct().withColumn("_there", F.lit(True))
    held = F.coalesce("_there", F.lit(False))
    end_file, end_pos = end.select("end_file").scalar(), end.select("end_pos").scalar()
    return saved.join(there, "file_no", "left").select(
        "tag",
        F.when(held, F.col("file_no")).otherwise(end_file).alias("file_no"),
        F.when(held, F.col("pos")).otherwise(end_pos).alias("pos"),
        (~held).alias("gap"),
    )


def lag(changes: DataFrame, file_no: int, pos: int) -> DataFrame:
    """X11: events not yet applied and how far the log has gone, per table."""
    waiting = after_position(file_no, pos)
    return changes.groupBy("tbl").agg(
        F.count_if(waiting).alias("pending"),
        F.max(F.struct("file_no", "pos")).alias("_end"),
    ).select("tbl", "pending", F.col("_end.file_no").alias("end_file"), F.col("_end.pos").alias("end_pos"))


def purge_applied(log: DataFrame, file_no: int, pos: int) -> DataFrame:
    """The log without what has been applied."""
    return log.filter(after_position(file_no, pos))


def _quoted(value: Column, kind: str) -> Column:
    if kind in BARE_TYPES:
        shown = value.cast("string")
    else:
        text = F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        shown = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(shown, F.lit("null"))


# fixed values: how a composite key part is written by type
_TYPED_KEY = {
    "tinyint": "toInt16({})", "int": "toInt32({})", "bigint": "toInt64({})", "float": "toFloat32({})",
    "double": "toFloat64({})", "date": "toDate('{}')", "datetime": "toDateTime('{}')",
}


def _typed_key(value: Column, kind: str) -> Column:
    head, tail = _TYPED_KEY.get(kind, "'{}'").split("{}")
    return F.concat(F.lit(head), F.coalesce(value.cast("string"), F.lit("None")), F.lit(tail))


def to_statement(changes: DataFrame, types: dict[str, str], keys: list[str], name: str = "statement") -> DataFrame:
    """Each event as insert, delete or delete-and-insert text; ``types`` maps the image columns to source types."""
    cols = list(types)
    header = F.concat(F.lit("insert into "), F.col("tbl"), F.lit(" (" + ",".join(f"`{c}`" for c in cols) + ")"))
    values = F.concat_ws(",", *[_quoted(F.col(c), types[c]) for c in cols])
    insert = F.concat(header, F.lit(" values ("), values, F.lit(")"))
    if len(keys) > 1:
        where = F.concat(
            F.lit(f"({','.join(keys)}) = (select "), F.concat_ws(",", *[_typed_key(F.col(k), types[k]) for k in keys]), F.lit(")")
        )
    else:
        where = F.concat(F.lit(f"{keys[0]} = "), _quoted(F.col(keys[0]), types[keys[0]]))
    delete = F.concat(F.lit("alter table "), F.col("tbl"), F.lit(" delete  where "), where)
    text = (
        F.when(F.col("op") == "insert", insert)
        .when(F.col("op") == "update", F.concat(delete, F.lit("^^^"), insert))
        .when(F.col("op") == "delete", delete)
    )
    return changes.withColumn(name, text)


CHANGE_SCHEMA = (
    "seq bigint, file_no bigint, pos bigint, tbl string, op string, before_pk bigint, pk bigint, val double, kind string, ts timestamp_ntz"
)
