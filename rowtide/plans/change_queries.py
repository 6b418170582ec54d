"""Queries for change capture, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowtide.operators import changes as cdc, images, ordered
from rowtide.operators.aggregates import ops_by_interval
from rowtide.plans import inputs
from rowtide.plans.inputs import with_inputs
from rowtide.plans.registry import query
from rowtide.session import scratch_path
from rowtide.sources.sinks import has_parquet
from rowtide.streaming import apply as applying, changes as streams, metrics, places, seen

KEYS, IMAGES = ["tbl", "pk"], ["val", "kind", "ts"]
COLS = ["tbl", "pk", "val", "kind", "ts"]
LOG = with_inputs("changes", "changed")


def net_sql(source: str = "changes", compat: bool = False) -> str:
    """Last event per key, with tombstones for keys an update has left."""
    moved = "" if compat else f" union all select tbl, before_pk, true, val, kind, ts, file_no, pos, seq from {source} where op = 'update' and before_pk <> pk"
    return (
        f"select *, row_number() over (partition by tbl, pk order by file_no desc, pos desc, seq desc) as rn from"
        f" (select tbl, pk, op = 'delete' as deleted, val, kind, ts, file_no, pos, seq from {source}{moved})"
    )


def apply_sql(source: str = "changes", target: str = "changed", compat: bool = False) -> str:
    return (
        f", net as ({net_sql(source, compat)}), last as (select * from net where rn = 1)"
        f" select tbl, pk, val, kind, ts from {target} c where not exists (select 1 from last l where l.tbl = c.tbl and l.pk = c.pk)"
        " union all select tbl, pk, val, kind, ts from last where not deleted"
    )


def _change_files(spark, d, df: DataFrame | None = None) -> str:
    path = scratch_path(spark, "log")
    streams.write_change_files(inputs.changes(spark, d) if df is None else df, path, files=8)
    return path


def _finish(query) -> None:
    query.awaitTermination()


@query("x1_read_changes", with_inputs("changes") + "select seq, file_no, pos, tbl, op, before_pk, pk, val, kind, ts from changes")
def x1(spark, d):
    out = scratch_path(spark, "read")
    stream = streams.read_changes(spark, _change_files(spark, d))
    _finish(streams.buffer_changes(stream, out, f"{out}-ck"))
    return spark.read.parquet(out)


@query("x2_buffer_changes", with_inputs("changes") + "select file_no, count(*) as rows, min(seq) as first_seq, max(seq) as last_seq from changes group by 1")
def x2(spark, d):
    """Several flushes, and a second start on the same checkpoint that must add nothing."""
    out, files = scratch_path(spark, "buffer"), _change_files(spark, d)
    for _ in range(2):
        _finish(streams.buffer_changes(streams.read_changes(spark, files, 3), out, f"{out}-ck"))
    return spark.read.parquet(out).groupBy("file_no").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _flushed(spark, log: str, name: str, **options) -> tuple[str, tuple[int, int]]:
    """Read a log with places to its end; where the flushes lie, and the place it has come to."""
    out = scratch_path(spark, name)
    flow = places.flush_places(places.read_places(spark, log, checkpoint=f"{out}-ck", **options), out, f"{out}-ck")
    try:
        flow.processAllAvailable()
    finally:
        flow.stop()
    return out, places.last_place(spark, f"{out}-ck", flushed=True) or options.get("start", places.BEGINNING)


@query(
    "x1_read_from_place",
    with_inputs("changes") + "select seq, file_no, pos, tbl, op, before_pk, pk, val, kind, ts from changes where file_no > 9 or (file_no = 9 and pos > 500)",
)
def x1_place(spark, d):
    """A stream that starts in the middle of a log file."""
    log = scratch_path(spark, "places")
    places.write_log(inputs.changes(spark, d), log)
    out, _ = _flushed(spark, log, "from-place", start=(9, 500))
    return spark.read.schema(places.CHANGE_SCHEMA).option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


@query(
    "x2_flush_by_rows",
    with_inputs("changes") + ", n as (select *, row_number() over (order by file_no, pos) - 1 as rn, count(*) over () // 5 + 1 as size from changes)"
    " select cast(rn // size as integer) as batch, count(*) as rows, min(seq) as first_seq, max(seq) as last_seq from n group by 1",
)
def x2_rows(spark, d):
    """Flushes of a fifth of the log each, which end in the middle of log files."""
    log, rows = scratch_path(spark, "places"), inputs.changes(spark, d)
    places.write_log(rows, log)
    out, _ = _flushed(spark, log, "flushes", max_rows=rows.count() // 5 + 1)
    return spark.read.parquet(out).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(
    "x8_resume_stream",
    with_inputs("changes") + "select 'a' as tag, false as gap, count(*) as rows, cast(sum(seq) as bigint) as seqs from changes"
    " union all select 'b', true, 0, null union all select 'c', false, count(*), cast(sum(seq) as bigint) from changes where file_no > 10 or (file_no = 10 and pos > 800)",
)
def x8_stream(spark, d):
    """Three jobs go on where X8 says: one behind its last flush, one whose log file is gone, one in the middle of a file."""
    log, rows = scratch_path(spark, "places"), inputs.changes(spark, d)
    places.write_log(rows.filter("file_no < 10"), log)
    first, place = _flushed(spark, log, "job-a", max_rows=300)
    places.write_log(rows.filter("file_no >= 10"), log)
    saved = spark.createDataFrame([("a", *place), ("b", 3, 7), ("c", 10, 800)], "tag string, file_no bigint, pos bigint")
    end = rows.agg(F.max("file_no").alias("end_file"), F.max_by("pos", F.struct("file_no", "pos")).alias("end_pos"))
    parts = spark.read.schema(places.CHANGE_SCHEMA).parquet(f"{first}/batch=*").select(F.lit("a").alias("tag"), F.lit(False).alias("gap"), "seq")
    for job in cdc.resume_position(saved, places.log_files(spark, log), end).collect():  # one row per job
        out, _ = _flushed(spark, log, f"job-{job['tag']}", start=(job["file_no"], job["pos"]))
        read = spark.read.schema(places.CHANGE_SCHEMA).parquet(out) if has_parquet(spark, out) else rows.limit(0)
        none = spark.createDataFrame([(job["tag"], job["gap"], None)], "tag string, gap boolean, seq bigint")
        parts = parts.unionByName(read.select(F.lit(job["tag"]).alias("tag"), F.lit(job["gap"]).alias("gap"), "seq")).unionByName(none)
    return parts.groupBy("tag", "gap").agg(F.count("seq").alias("rows"), F.sum("seq").alias("seqs"))


@query("x3_apply_changes", LOG + apply_sql())
def x3(spark, d):
    return cdc.apply_changes(inputs.changed(spark, d), inputs.changes(spark, d), KEYS, IMAGES)


@query("x3_apply_changes_stream", LOG + apply_sql())
def x3_stream(spark, d):
    """The same through files and micro-batches."""
    path = scratch_path(spark, "applied")
    applying.write_snapshot(inputs.changed(spark, d), path)
    stream = streams.read_changes(spark, _change_files(spark, d), 4)
    _finish(applying.start_apply(stream, path, f"{path}-ck", IMAGES))
    return applying.live_rows(spark, path, COLS)


@query("x4_apply_key_change", with_inputs("changes") + f", net as ({net_sql()}) select tbl, pk, deleted, seq from net where rn = 1")
def x4(spark, d):
    return cdc.net_changes(inputs.changes(spark, d), KEYS, IMAGES).select("tbl", "pk", "deleted", "seq")


@query("x4_apply_key_change_compat", LOG + apply_sql(compat=True))
def x4_compat(spark, d):
    return cdc.apply_changes(inputs.changed(spark, d), inputs.changes(spark, d), KEYS, IMAGES, compat=True)


@query(
    "x5_idempotent_insert",
    with_inputs("orders_tgt") + "select * from orders_tgt union all select * from orders_src where order_id not in (select order_id from orders_tgt)",
)
def x5(spark, d):
    src = inputs.orders_src(spark, d)
    return cdc.idempotent_insert(inputs.orders_tgt(spark, d), src.unionByName(src.filter("order_id % 3 = 0")), ["order_id"])


@query("x5_dedupe_stream", with_inputs("changes") + "select tbl, op, count(*) as n, cast(sum(seq) as bigint) as seqs from changes group by 1, 2")
def x5_stream(spark, d):
    """A log in which every third event was delivered twice, read in several batches out of order."""
    log = inputs.changes(spark, d)
    files = _change_files(spark, d, log.unionByName(log.filter("seq % 3 = 0")))
    out = scratch_path(spark, "deduped")
    _finish(seen.dedupe_stream(streams.read_changes(spark, files, 3), out, f"{out}-ck"))
    return spark.read.parquet(out).groupBy("tbl", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


# places at which the tables' snapshots were taken; the third table has none and takes every event
_PLACES = "places as (select 'app.t0' as tbl, 9 as f, 500 as p union all select 'app.t1', 10, 4000)"
_LATER = "later as (select c.* from changes c left join places s on c.tbl = s.tbl where s.f is null or c.file_no > s.f or (c.file_no = s.f and c.pos > s.p))"


@query("x6_snapshot_then_changes", LOG + f", {_PLACES}, {_LATER}" + apply_sql("later"))
def x6(spark, d):
    places = {"app.t0": (9, 500), "app.t1": (10, 4000)}
    return cdc.snapshot_then_changes(inputs.changed(spark, d), places, inputs.changes(spark, d), KEYS, IMAGES)


_REPLAY = (
    "replay as (select * from changes where tbl in ('app.t0', 'app.t1') and (file_no > 9 or (file_no = 9 and pos > 500)) and (file_no < 12 or (file_no = 12 and pos <= 800))),"
    " known as (select * from changed where tbl <> 'app.t2')"
)


@query("x7_catch_up", LOG + f", {_REPLAY}" + apply_sql("replay", "known") + " union all select tbl, pk, val + 1, kind, ts from changed where tbl = 'app.t2'")
def x7(spark, d):
    target = inputs.changed(spark, d)
    known = target.filter("tbl <> 'app.t2'")
    return cdc.catch_up(known, target.withColumn("val", F.col("val") + 1), ["app.t0", "app.t1"], inputs.changes(spark, d), (9, 500), (12, 800), KEYS, IMAGES)


@query(
    "x8_resume_position",
    with_inputs("changes") + ", s as (select tbl || '/' || kind || '/' || cast(pk % 5 as varchar) as tag, min(file_no) as file_no, max(pos) as pos from changes group by 1),"
    " e as (select max(file_no) as ef, arg_max(pos, seq) as ep from changes)"
    " select tag, case when file_no >= 9 then file_no else ef end as file_no, case when file_no >= 9 then pos else ep end as pos, file_no < 9 as gap from s, e",
)
def x8(spark, d):
    log = inputs.changes(spark, d)
    tag = F.concat_ws("/", "tbl", "kind", (F.col("pk") % 5).cast("string"))
    saved = log.groupBy(tag.alias("tag")).agg(F.min("file_no").alias("file_no"), F.max("pos").alias("pos"))
    end = log.agg(F.max("file_no").alias("end_file"), F.max_by("pos", "seq").alias("end_pos"))
    return cdc.resume_position(saved, log.filter("file_no >= 9").select("file_no"), end)


# places, the table a statement was logged under, its text: three tables of two schemas, and one nobody follows
DDL = [
    (9, 3, 0, "app.t0", "alter table app.t0 add column note varchar(20), change kind label varchar(20)"),
    (9, 3, 1, "crm.t2", "ALTER TABLE `crm`.`t2` ADD COLUMN note varchar(20) FIRST"),
    (9, 900, 0, "app.x", "alter table t1 modify val int"),
    (10, 3, 0, "app.t0", "alter table app.t0 add column if not exists note int"),
    (10, 3, 1, "app.t0", "truncate table crm.t2"),
    (10, 4000, 0, "app.t1", "alter table app.t1 modify column val varchar (30) default 'a, b'"),
    (11, 3, 0, "app.t0", "alter table app.t0 drop column if exists val"),
    (11, 3, 1, "other.t9", "alter table other.t9 drop column val"),
    (12, 3, 0, "app.t0", "alter table app.t0 add column val decimal(10, 2)"),
    (12, 3, 1, "crm.t2", "alter table crm.t2 change pk id bigint"),
]
_NAMED = "case tbl when 'app.t2' then 'crm.t2' else tbl end"
_X9 = (
    LOG + f", named as (select * replace ({_NAMED} as tbl, floor(val) as val) from changes), base as (select * replace ({_NAMED} as tbl) from changed),"
    " logged as (select * from named where tbl <> 'crm.t2' or file_no > 10 or (file_no = 10 and pos > 3)),"
    f" net as ({net_sql('logged')}), last as (select * from net where rn = 1), v as (select *, cast(cast(val as bigint) as varchar) as t from last where not deleted),"
    " rest as (select * from base b where tbl <> 'crm.t2' and not exists (select 1 from last l where l.tbl = b.tbl and l.pk = b.pk))"
    " select tbl, pk, case when tbl = 'app.t1' then cast(cast(trunc(val) as integer) as varchar) end as val, kind, null::varchar as note, ts from rest"
    " union all select tbl, pk, case when tbl = 'app.t0' then case when file_no > 12 or (file_no = 12 and pos > 3) then t || '.00' end else t end,"
    " case when tbl = 'app.t0' and (file_no > 9 or (file_no = 9 and pos > 3)) then upper(kind) else kind end,"
    " case when tbl <> 'app.t1' and (file_no > 9 or (file_no = 9 and pos > 3)) then 'n' || cast(seq as varchar) end, ts from v"
)
TABLE_KEYS = {"app.t0": ["pk"], "app.t1": ["pk"], "crm.t2": ["id"]}


def _image_log(spark, d) -> DataFrame:
    """The change log with whole images as text, and the statements between its rows."""
    text = F.floor("val").cast("string")

    def image(pk: str):
        return F.create_map(
            F.lit("pk"), F.col(pk).cast("string"), F.lit("id"), F.col(pk).cast("string"), F.lit("val"), text, F.lit("kind"), F.col("kind"), F.lit("label"), F.upper("kind"),
            F.lit("note"), F.concat(F.lit("n"), F.col("seq").cast("string")), F.lit("ts"), F.col("ts").cast("string"),
        )

    tbl = F.when(F.col("tbl") == "app.t2", "crm.t2").otherwise(F.col("tbl"))
    rows = inputs.changes(spark, d).select(
        "file_no", "pos", "seq", tbl.alias("tbl"), "op", image("before_pk").alias("before"), image("pk").alias("after"), F.lit(None).cast("string").alias("statement")
    )
    marks = spark.createDataFrame(DDL, "file_no bigint, pos bigint, seq bigint, tbl string, statement string")
    none = F.lit(None).cast("map<string,string>")
    return rows.unionByName(marks.select("file_no", "pos", "seq", "tbl", F.lit("query").alias("op"), none.alias("before"), none.alias("after"), "statement"))


def _tables_before(spark, d) -> dict[str, DataFrame]:
    rows = inputs.changed(spark, d)
    return {new: rows.filter(F.col("tbl") == old).drop("tbl") for old, new in (("app.t0", "app.t0"), ("app.t1", "app.t1"), ("app.t2", "crm.t2"))}


def _together(tables: dict[str, DataFrame]) -> DataFrame:
    names = {"app.t0": ("pk", "label", "note"), "app.t1": ("pk", "kind", None), "crm.t2": ("id", "kind", "note")}
    parts = [
        df.select(F.lit(t).alias("tbl"), F.col(names[t][0]).alias("pk"), F.col("val").cast("string").alias("val"), F.col(names[t][1]).alias("kind"), (F.col(names[t][2]) if names[t][2] else F.lit(None).cast("string")).alias("note"), "ts")
        if t != "crm.t2" else df.select(F.lit(t).alias("tbl"), F.col("id").alias("pk"), F.col("val").cast("bigint").cast("string").alias("val"), "kind", "note", "ts")
        for t, df in tables.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x9_route_ddl", _X9)
def x9(spark, d):
    """Ten schema changes of three tables in the middle of their row changes."""
    return _together(images.route_tables(_tables_before(spark, d), _image_log(spark, d), TABLE_KEYS))


@query("x9_route_ddl_stream", _X9)
def x9_stream(spark, d):
    """The same through files in several batches."""
    files, path, before = scratch_path(spark, "log"), scratch_path(spark, "routed"), _tables_before(spark, d)
    streams.write_change_files(_image_log(spark, d), files, files=8)
    stream = streams.read_changes(spark, files, 3, images.IMAGE_SCHEMA)
    _finish(applying.start_routing(stream, path, f"{path}-ck", before, TABLE_KEYS))
    return _together(applying.routed_tables(spark, path, before, TABLE_KEYS))


# keys of two parts, a text and a number; updates may change either part, so that rows move
_PAIR = "select seq, file_no, pos, tbl, op, before_pk % 40 as n0, pk % 40 as n1, case when before_pk % 7 = 0 then null else 'k' || cast(before_pk % 5 as varchar) end as c0, case when pk % 7 = 0 then null else 'k' || cast(pk % 5 as varchar) end as c1, floor(val) as val, ts from changes"
_PAIRS = (
    with_inputs("changes", "changed") + f", e as ({_PAIR}), b as (select tbl, case when pk % 7 = 0 then null else 'k' || cast(pk % 5 as varchar) end as code, pk % 40 as n, min(val) as val from changed group by 1, 2, 3),"
    " f as (select tbl, c1 as code, n1 as n, op = 'delete' as deleted, val, ts, file_no, pos, seq, 1 as part from e where op <> 'delete' union all select tbl, c0, n0, true, val, ts, file_no, pos, seq, 1 from e where op = 'delete'"
    " union all select tbl, c0, n0, true, val, ts, file_no, pos, seq, 0 from e where op = 'update' and (c0 is distinct from c1 or n0 <> n1)),"
    " l as (select *, row_number() over (partition by tbl, code, n order by file_no desc, pos desc, seq desc) as rn from f)"
)


@query(
    "x3_apply_composite_keys",
    _PAIRS + " select tbl, code, n, val, null::timestamp as ts from b where not exists (select 1 from l where l.tbl = b.tbl and l.code is not distinct from b.code and l.n = b.n)"
    " union all select tbl, code, n, val, ts from l where rn = 1 and not deleted",
)
def x3_pairs(spark, d):
    """Tables whose key is a text (with nulls) and a number; an update that changes either part moves the row."""
    tables, log = _pair_tables(spark, d), _pair_log(spark, d)
    done = images.route_tables(tables, log, {t: ["code", "n"] for t in tables})
    parts = [df.select(F.lit(t).alias("tbl"), "code", "n", "val", "ts") for t, df in done.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("x4_move_composite_keys", _PAIRS + " select tbl, code, cast(n as varchar) as n, deleted, seq from l where rn = 1")
def x4_pairs(spark, d):
    tables, log = _pair_tables(spark, d), _pair_log(spark, d)
    _, info = images.tables_of(tables, images.statements_of(log), {t: ["code", "n"] for t in tables})
    return images.net_images(log, info).select("tbl", F.col("key")[0].alias("code"), F.col("key")[1].alias("n"), "deleted", "seq")


def _code(pk: str):
    return F.when(F.col(pk) % 7 != 0, F.concat(F.lit("k"), (F.col(pk) % 5).cast("string")))


def _pair_tables(spark, d) -> dict[str, DataFrame]:
    rows = inputs.changed(spark, d).groupBy("tbl", _code("pk").alias("code"), (F.col("pk") % 40).alias("n")).agg(F.min("val").alias("val"))
    rows = rows.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return {t: rows.filter(F.col("tbl") == t).drop("tbl") for t in ("app.t0", "app.t1", "app.t2")}


def _pair_log(spark, d) -> DataFrame:
    def image(pk: str):
        return F.create_map(F.lit("code"), _code(pk), F.lit("n"), (F.col(pk) % 40).cast("string"), F.lit("val"), F.floor("val").cast("string"), F.lit("ts"), F.col("ts").cast("string"))

    return inputs.changes(spark, d).select("file_no", "pos", "seq", "tbl", "op", image("before_pk").alias("before"), image("pk").alias("after"), F.lit(None).cast("string").alias("statement"))


@query(
    "x10_ops_metrics",
    with_inputs("changes") + "select date_trunc('hour', ts)::timestamp as window_start, count(*) as event_amount, count(*) filter (op = 'insert') as insert_amount,"
    " count(*) filter (op = 'update') as update_amount, count(*) filter (op = 'delete') as delete_amount, 0::bigint as ddl_amount from changes"
    " group by 1",
)
def x10(spark, d):
    """All windows, counted over several batches."""
    out = scratch_path(spark, "metrics")
    _finish(metrics.ops_metrics(streams.read_changes(spark, _change_files(spark, d), 3), 3600, out, f"{out}-ck"))
    return metrics.read_ops_metrics(spark, out)


@query(
    "x10_ops_without_time",
    with_inputs("changes") + "select date_trunc('day', case when seq % 9 <> 0 then ts end)::timestamp as window_start, count(*) as event_amount, count(*) filter (op = 'delete') as delete_amount from changes group by 1",
)
def x10_no_time(spark, d):
    """Changes without a time are counted too."""
    rows = inputs.changes(spark, d).withColumn("ts", F.when(F.col("seq") % 9 != 0, F.col("ts")))
    return ops_by_interval(rows, 86400).select("window_start", "event_amount", "delete_amount")


@query("x10_ops_metrics_batch", with_inputs("changes") + "select date_trunc('day', ts)::timestamp as window_start, count(*) as event_amount from changes group by 1")
def x10_batch(spark, d):
    return ops_by_interval(inputs.changes(spark, d), 86400).select("window_start", "event_amount")


@query(
    "x11_lag",
    with_inputs("changes") + "select tbl, count(*) filter (file_no > 9 or (file_no = 9 and pos > 500)) as pending, max(file_no) as end_file, arg_max(pos, file_no * 100000 + pos) as end_pos from changes group by 1",
)
def x11(spark, d):
    return cdc.lag(inputs.changes(spark, d), 9, 500)


@query("x12_purge_applied", with_inputs("changes") + "select seq, file_no, pos from changes where file_no > 9 or (file_no = 9 and pos > 500)")
def x12(spark, d):
    return cdc.purge_applied(inputs.changes(spark, d), 9, 500).select("seq", "file_no", "pos")


@query("x13_fan_out", with_inputs("changes") + f", net as ({net_sql()}) select tbl, count(*) filter (not deleted) as live, count(*) filter (deleted) as gone, max(seq) as last_seq from net where rn = 1 group by 1")
def x13(spark, d):
    """All tables in one stream, applied in log order."""
    path = scratch_path(spark, "fan")
    stream = streams.read_changes(spark, _change_files(spark, d), 4)
    _finish(applying.start_apply(stream, path, f"{path}-ck", IMAGES))
    target = applying.read_target(spark, path)
    return target.groupBy("tbl").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("gone"), F.max("seq").alias("last_seq"))


@query(
    "x14_merge_inserts",
    with_inputs("changes") + ", m as (select *, row_number() over (partition by tbl order by file_no, pos, seq) - row_number() over (partition by tbl, op order by file_no, pos, seq) as g from changes)"
    " select tbl, count(*) as n, min(seq) as first_id, max(seq) as last_id from m where op = 'insert' group by tbl, g",
)
def x14(spark, d):
    return ordered.runs(inputs.changes(spark, d)).filter("statement = 'insert' and part = 0").select("tbl", "n", "first_id", "last_id")


TYPES = {"pk": "bigint", "kind": "varchar", "note": "varchar", "ts": "datetime"}
_VALUES = "cast(pk as varchar) || ',' || '''' || kind || ''',' || case when note is null then 'null' else '''it\\''s ' || cast(seq as varchar) || '''' end || ',''' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ''''"
_INSERT = f"'insert into ' || tbl || ' (`pk`,`kind`,`note`,`ts`) values (' || {_VALUES} || ')'"
_DELETE = "'alter table ' || tbl || ' delete  where pk = ' || cast(pk as varchar)"


@query(
    "x15_to_statement",
    with_inputs("changes") + ", n as (select seq, tbl, op, pk, kind, date_trunc('second', ts) as ts, case when seq % 2 = 0 then 'it''s' end as note from changes)"
    f" select seq, case op when 'insert' then {_INSERT} when 'update' then {_DELETE} || '^^^' || {_INSERT} else {_DELETE} end as statement from n",
)
def x15(spark, d):
    rows = inputs.changes(spark, d).select(
        "seq", "tbl", "op", "pk", "kind", F.expr("case when seq % 2 = 0 then concat('it''s ', cast(seq as string)) end").alias("note"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
    )
    return cdc.to_statement(rows, TYPES, ["pk"]).select("seq", "statement")
