"""Schemas, keys and statements."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: column types of the source and what they become in each target
CLICKHOUSE_TYPES = {
    "tinyint": "Int16", "int": "Int32", "bigint": "Int64", "varchar": "String", "timestamp": "DateTime",
    "datetime": "DateTime", "date": "Date", "text": "String", "longtext": "String", "float": "Float32", "double": "Float64",
}
DORIS_TYPES = {"varchar": "String", "timestamp": "datetime", "longtext": "text"}
DORIS_BATCH_TYPES = {"varchar": "String", "longtext": "String", "tinyint": "int", "time": "String", "year": "String", "timestamp": "datetime"}
POSTGRES_TYPES = {
    "integer": "int", "real": "numeric(20,2)", "date": "date", "timestamp without time zone": "datetime",
    "text": "varchar(100)", "uuid": "varchar(50)",
}
POSTGRES_OTHER = "varchar(500)"
SQLSERVER_TYPES = {
    "nvarchar": "varchar", "varchar(-1)": "longtext", "datetime(23)": "datetime", "datetime2(27)": "datetime",
    "time(16)": "time", "date(10)": "date", "numeric": "decimal", "money": "decimal", "smalldatetime(16)": "datetime",
    "smalldatetime": "datetime", "float": "decimal", "bit": "varchar", "timestamp(8)": "varchar(50)",
}
SPARK_TYPES = {
    "tinyint": "smallint", "int": "int", "bigint": "bigint", "varchar": "string", "timestamp": "timestamp_ntz",
    "datetime": "timestamp_ntz", "date": "date", "text": "string", "longtext": "string", "float": "float", "double": "double",
}


def _lookup(types: dict[str, str], col: Column, other: Column) -> Column:
    entries = [F.lit(x) for pair in types.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), col), other)


def map_schema(columns: DataFrame, dialect: str) -> DataFrame:
    """B1: target type of every described column (data_type, is_nullable, datetime_precision)."""
    kind = F.lower("data_type")
    if dialect == "clickhouse":
        base = F.when((kind == "datetime") & (F.col("datetime_precision") == 6), "DateTime64").otherwise(
            _lookup(CLICKHOUSE_TYPES, kind, F.lit("String"))
        )
        target = F.when(F.col("is_nullable") == "NO", base).otherwise(F.concat(F.lit("Nullable("), base, F.lit(")")))
    elif dialect == "doris":
        target = _lookup(DORIS_TYPES, kind, kind)
    elif dialect == "doris_batch":
        target = _lookup(DORIS_BATCH_TYPES, kind, kind)
    elif dialect == "postgres":
        target = _lookup(POSTGRES_TYPES, kind, F.lit(POSTGRES_OTHER))
    elif dialect == "sqlserver":
        plain = F.trim(F.replace(kind, F.lit("identity(1,1)"), F.lit("")))
        name = F.regexp_extract(plain, r"^(\w+)", 1)
        size = F.regexp_extract(plain, r"(\(.*\))$", 1)
        by_name = F.concat(_lookup(SQLSERVER_TYPES, name, name), size)
        target = _lookup(SQLSERVER_TYPES, plain, by_name)
    else:
        raise ValueError(f"unknown dialect {dialect}")
    return columns.withColumn("target_type", target)


def target_struct(columns: list[tuple[str, str, bool]], legacy_types: bool = False) -> T.StructType:
    """B1: Spark schema of (name, type text, nullable) descriptions; decimals stay exact unless ``legacy_types``."""
    fields = []
    for name, kind, nullable in columns:
        kind = kind.lower()
        if kind.startswith("decimal"):
            ddl = "string" if legacy_types else (kind if "(" in kind else "decimal(38,10)")
        else:
            ddl = SPARK_TYPES.get(re.sub(r"\(.*", "", kind), "string")
        fields.append(T.StructField(name, T.StructType.fromDDL(f"c {ddl}")[0].dataType, nullable))
    return T.StructType(fields)


# fixed values: words that begin an index, key or constraint clause; such clauses change no column
CLAUSES = ("INDEX", "KEY", "PRIMARY", "UNIQUE", "FULLTEXT", "SPATIAL", "FOREIGN", "CONSTRAINT", "CHECK", "PARTITION")
# fixed values: words that begin a clause about the table itself
TABLE_CLAUSES = (
    "ALGORITHM", "ALTER", "ANALYZE", "AUTO_INCREMENT", "CHARACTER", "CHARSET", "CHECKSUM", "COALESCE", "COLLATE", "COMMENT", "CONVERT", "DEFAULT", "DELAY_KEY_WRITE",
    "DISABLE", "DISCARD", "ENABLE", "ENGINE", "FORCE", "IMPORT", "LOCK", "MAX_ROWS", "MIN_ROWS", "OPTIMIZE", "ORDER", "PACK_KEYS", "REBUILD", "REMOVE", "REORGANIZE",
    "ROW_FORMAT", "STATS_PERSISTENT", "TABLESPACE", "TRUNCATE", "WITH", "WITHOUT",
)

_TOKEN = re.compile(r"""\s+|/\*.*?\*/|--[^\n]*|\#[^\n]*|`(?P<quoted>(?:[^`]|``)*)`|"(?P<named>(?:[^"]|"")*)"|(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<word>[\w$]+)|(?P<mark>.)""", re.S)


class Token(NamedTuple):
    text: str
    kind: str  # word, name (quoted), text (a literal) or mark

    def says(self, *words: str) -> bool:
        return self.kind in ("word", "mark") and self.text.upper() in words


class Step(NamedTuple):
    """One change of a column: add, drop, retype or rename; ``after`` names the column an added or moved one follows, '' is the first place."""

    action: str
    column: str
    new: str | None = None
    kind: str | None = None
    after: str | None = None


def _tokens(text: str) -> list[Token]:
    """Words, names, literals and marks of a statement; blanks and comments are left out."""
    out = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "quoted":
            out.append(Token(m["quoted"].replace("``", "`"), "name"))
        elif m.lastgroup == "named":
            out.append(Token(m["named"].replace('""', '"'), "name"))
        elif m.lastgroup:
            out.append(Token(m[m.lastgroup], m.lastgroup))
    return out


def _parts(tokens: list[Token]) -> list[list[Token]]:
    """Runs of tokens between commas that stand outside of brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += t.says("(") - t.says(")")
        if t.says(",") and not depth:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


class _Clause:
    """The tokens of one clause, read from left to right."""

    def __init__(self, tokens: list[Token]):
        self.left = list(tokens)

    def takes(self, *words: str) -> bool:
        """Goes past these words if they come next."""
        if len(self.left) >= len(words) and all(t.says(w) for t, w in zip(self.left, words)):
            del self.left[: len(words)]
            return True
        return False

    def begins(self, words: tuple[str, ...]) -> bool:
        return bool(self.left) and self.left[0].kind == "word" and self.left[0].text.upper() in words

    def name(self) -> str:
        if not self.left or self.left[0].kind not in ("word", "name"):
            raise ValueError("a name is missing")
        return self.left.pop(0).text

    def bracket(self) -> str:
        """A bracketed text, without blanks; nothing if there is none."""
        if not self.left or not self.left[0].says("("):
            return ""
        out, depth = "", 0
        while self.left:
            t = self.left.pop(0)
            depth += t.says("(") - t.says(")")
            out += t.text
            if not depth:
                return out
        raise ValueError("a bracket is not closed")

    def column(self) -> tuple[str, str, str | None]:
        """A column definition: its name, its type and the column it follows."""
        name, kind = self.name(), self.name().lower()
        if kind in ("double", "long") and self.begins(("PRECISION",)):
            self.left.pop(0)
        kind += self.bracket()
        if self.takes("UNSIGNED"):
            kind += " unsigned"
        after = None
        for i, t in enumerate(self.left):
            if t.says("FIRST") and i + 1 == len(self.left):
                after = ""
            elif t.says("AFTER") and i + 2 == len(self.left):
                after = self.left[i + 1].text
        return name, kind, after


def _clause_steps(tokens: list[Token]) -> list[Step]:
    c = _Clause(tokens)
    action = c.left.pop(0).text.upper() if c.left[0].kind == "word" else ""
    named = c.takes("COLUMN")
    if action in ("ADD", "DROP", "RENAME") and not named and c.begins(CLAUSES):
        return []
    if action == "ADD":
        c.takes("IF", "NOT", "EXISTS")
        if c.left and c.left[0].says("(") and c.left[-1].says(")"):
            made = [_Clause(p) for p in _parts(c.left[1:-1])]
            return [Step("add", name, None, kind, after) for name, kind, after in (x.column() for x in made if not x.begins(CLAUSES))]
        name, kind, after = c.column()
        return [Step("add", name, None, kind, after)]
    if action == "DROP":
        c.takes("IF", "EXISTS")
        return [Step("drop", c.name())]
    if action == "MODIFY":
        c.takes("IF", "EXISTS")
        name, kind, after = c.column()
        return [Step("retype", name, None, kind, after)]
    if action == "CHANGE":
        c.takes("IF", "EXISTS")
        old = c.name()
        name, kind, after = c.column()
        if old.lower() == name.lower():
            return [Step("retype", old, None, kind, after)]
        return [Step("rename", old, name.lower(), None, after)]
    if action == "RENAME" and named:
        old = c.name()
        if not c.takes("TO"):
            raise ValueError("TO is missing")
        return [Step("rename", old, c.name().lower())]
    if action == "RENAME" or action in TABLE_CLAUSES:
        return []
    raise ValueError(f"unknown clause {action}")


def alter_steps(statement: str) -> list[Step]:
    """The column changes of one ``alter table`` text, several clauses in their order.

    Index, key, constraint and table clauses change no column and give no step; a bracketed list of added columns gives one
    step each. Names may be quoted, types may hold blanks, and defaults, comments and other attributes are passed over.
    A clause that can't be read raises ValueError rather than being passed over.
    """
    tokens = [t for t in _tokens(statement.strip().rstrip(";"))]
    head = _Clause(tokens)
    if not head.takes("ALTER", "TABLE"):
        raise ValueError(f"no alter table statement: {statement!r}")
    head.takes("IF", "EXISTS")
    head.name()
    while head.left and head.left[0].says("."):
        head.left.pop(0)
        head.name()
    steps: list[Step] = []
    for part in _parts(head.left):
        try:
            steps += _clause_steps(part)
        except ValueError as error:
            raise ValueError(f"can't read the clause {' '.join(t.text for t in part)!r}: {error}") from None
    return steps


def ddl_steps(statement: str) -> list[tuple[str, str, str | None, str | None]]:
    """The column changes of one ``alter table`` text as (action, column, new name, type)."""
    return [tuple(s[:4]) for s in alter_steps(statement)]


# fixed values: what holds the whole range of an unsigned type
_UNSIGNED = {"tinyint": "smallint", "smallint": "int", "mediumint": "int", "int": "bigint", "integer": "bigint", "bigint": "decimal(20,0)"}


def spark_type(kind: str) -> T.DataType:
    """The type of a column described as ``kind``."""
    if kind.endswith(" unsigned"):
        base = re.sub(r"\(.*", "", kind.removesuffix(" unsigned")).strip()
        return T.StructType.fromDDL(f"c {_UNSIGNED[base]}")[0].dataType if base in _UNSIGNED else spark_type(kind.removesuffix(" unsigned"))
    return target_struct([("c", kind, True)])[0].dataType


def _placed(frame: DataFrame, name: str, after: str | None) -> DataFrame:
    """The columns with ``name`` behind ``after`` ('' is in front); as they are if nothing is said."""
    held = {c.lower(): c for c in frame.columns}
    if after is None or (after and after.lower() not in held):
        return frame
    rest = [c for c in frame.columns if c != held[name.lower()]]
    at = rest.index(held[after.lower()]) + 1 if after else 0
    return frame.select(*[F.col(f"`{c}`") for c in [*rest[:at], held[name.lower()], *rest[at:]]])


def apply_ddl(df: DataFrame, statements: list[str]) -> DataFrame:
    """B2: the table after a series of ``alter table`` statements; values that do not fit a new type become null."""

    def step(frame: DataFrame, change: Step) -> DataFrame:
        held = {c.lower(): c for c in frame.columns}.get(change.column.lower())
        if change.action == "add":
            name = change.column.lower()
            return frame if held else _placed(frame.withColumn(name, F.lit(None).cast(spark_type(change.kind))), name, change.after)
        if held is None:
            return frame
        if change.action == "drop":
            return frame.drop(held)
        if change.action == "retype":
            return _placed(frame.withColumn(held, F.col(f"`{held}`").try_cast(spark_type(change.kind))), held, change.after)
        return _placed(frame.withColumnRenamed(held, change.new), change.new, change.after)

    return reduce(step, [s for text in statements for s in alter_steps(text)], df)


def add_missing_columns(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target with the source columns it lacks, as nulls, in source order behind its own."""
    have = {c.lower() for c in target.columns}
    lacking = [f for f in source.schema.fields if f.name.lower() not in have]
    return target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])


def classify_statement(statements: DataFrame, col: str = "statement") -> DataFrame:
    """Kind and object of each statement of a log; the object comes without schema and backticks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.col(col), "`", ""), r"\s+", " "))
    evened = statements.withColumn("_text", plain).withColumn("_up", F.upper("_text"))
    text, up = F.col("_text"), F.col("_up")
    alter = F.regexp_extract(up, r"^ALTER TABLE \S+ (ADD|DROP|CHANGE)\b", 1)
    made = F.regexp_extract(up, r"^(CREATE|DROP) (TABLE|INDEX|DATABASE)\b", 0)
    op = (
        F.when(made != "", F.replace(made, F.lit(" "), F.lit("_")))
        .when(up.rlike(r"^TRUNCATE\b"), "TRUNCATE_TABLE")
        .when(alter != "", F.concat(F.lit("ALTER_TABLE_"), alter))
        .when(up.rlike(r"^(INSERT|UPDATE|DELETE)\b"), F.regexp_extract(up, r"^(\w+)", 1))
    )
    patterns = [
        r"(?i)^CREATE UNIQUE INDEX ([^\s(]+)",
        r"(?i)^(?:CREATE|DROP|TRUNCATE|ALTER) (?:TABLE|INDEX|DATABASE|VIEW|FUNCTION|PROCEDURE|TRIGGER) (?:IF (?:NOT )?EXISTS )?([^\s(;]+)",
        r"(?i)^(?:INSERT INTO|DELETE FROM) ([^\s(;]+)",
        r"(?i)^UPDATE ([^\s(;]+)",
    ]
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])
    return evened.withColumn("op", op).withColumn("object", F.substring_index(found, ".", -1)).drop("_text", "_up")


def keep_ddl(statements: DataFrame, col: str = "statement") -> DataFrame:
    """Only statements that create, drop, truncate or alter a table."""
    return statements.filter(F.col(col).rlike(r"(?i)\b(create|drop|truncate|alter)\s+table\b"))


def carry_comments(source: DataFrame, target: DataFrame) -> DataFrame:
    """Column comments of the source on the equally named target columns."""
    comments = {f.name.lower(): f.metadata["comment"] for f in source.schema.fields if "comment" in f.metadata}
    for name in target.columns:
        if name.lower() in comments:
            meta = {**target.schema[name].metadata, "comment": comments[name.lower()]}
            target = target.withMetadata(name, meta)
    return target


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    for name, comment in comments.items():
        df = df.withMetadata(name, {"comment": comment})
    return df


def key_candidates(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """For each candidate key whether it is free of nulls and repeats; each is its own aggregation."""

    def probe(i: int, cols: list[str]) -> DataFrame:
        no_nulls = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
        return groups.agg(
            F.lit(i).alias("priority"), F.lit(",".join(cols)).alias("candidate"),
            F.coalesce(F.bool_and(no_nulls & (F.col("_n") == 1)), F.lit(False)).alias("is_key"),
        )

    return reduce(DataFrame.unionByName, [probe(i, cols) for i, cols in enumerate(candidates)])


def find_key(df: DataFrame, candidates: list[list[str]]) -> list[str] | None:
    """The first candidate that is a key, else none."""
    row = key_candidates(df, candidates).filter("is_key").orderBy("priority").limit(1).first()
    return row["candidate"].split(",") if row else None


def post_load_rewrite(df: DataFrame, key: str, mapping: dict[str, str], name: str) -> DataFrame:
    """Only rows whose key is in the mapping, with the mapped value in a column."""
    value = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(key))
    return df.filter(F.col(key).isin(*mapping)).withColumn(name, value)


def rename_schema(events: DataFrame, mapping: dict[str, str], prefix: str = "") -> DataFrame:
    """Target schema of each event: prefix and the mapped name ('auto' keeps it); unlisted schemas go to 'test'."""
    schema = F.substring_index("tbl", ".", 1)
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    mapped = F.element_at(F.create_map(*pairs), schema)
    resolved = F.when(mapped == "auto", schema).otherwise(mapped)
    return events.withColumn("dest_schema", F.coalesce(F.concat(F.lit(prefix), resolved), F.lit("test")))
