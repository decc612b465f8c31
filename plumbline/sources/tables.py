"""Named sources of tables: registration as views, listing, schemas, uploads, comments, sampled imports, sinks."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERNAL = ("sqlite_", "_dm_", "ont_", "up_")
FULL_COPY, SAMPLE = 50_000, 20_000
#: Declared types that keep their place in a schema but are not copied.
SKIPPED_TYPES = ("blob", "binary", "longtext", "mediumtext", "json", "geometry")


@dataclass(frozen=True)
class Source:
    """A registered folder of Parquet tables, read-only: nothing here writes to it."""

    id: str
    path: str
    tables: tuple[str, ...]


class Sources:
    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def register(self, source: Source, prefix: str = "") -> list[str]:
        """Temp views <prefix><table>; a view name that exists already is skipped and not in the answer."""
        done = []
        for t in source.tables:
            name = f"{prefix}{t}"
            if not self.spark.catalog.tableExists(name):
                self.spark.read.parquet(f"{source.path}/{t}.parquet").createTempView(name)
                done.append(name)
        self.known[source.id] = source
        return done

    def resolve(self, id: str) -> Source:
        if id not in self.known:
            raise KeyError(f"unknown source {id}")
        return self.known[id]

    def same(self, a: str, b: str) -> bool:
        return self.resolve(a).path.rstrip("/") == self.resolve(b).path.rstrip("/")

    def user_tables(self, scope: Collection[str] | None = None) -> list[str]:
        names = [t.name for t in self.spark.catalog.listTables()]
        return sorted(n for n in names if not n.startswith(INTERNAL) and (scope is None or n in scope))

    def schema(self, tables: Sequence[str] | None = None) -> dict[str, list[tuple[str, str]]]:
        return {t: [(f.name, f.dataType.simpleString()) for f in self.spark.table(t).schema.fields] for t in tables or self.user_tables()}

    def folded_schema(self) -> dict[str, dict[str, str]]:
        return {t.lower(): {c.lower(): c for c, _ in cols} for t, cols in self.schema().items()}

    def upload(self, name: str, df: DataFrame) -> str:
        """An uploaded table: view up_<name>, apart from the source's own names."""
        view = f"up_{re.sub(r'[^0-9A-Za-z_]', '_', name)}"
        df.createOrReplaceTempView(view)
        return view

    def with_cleaning(self, views: dict[str, DataFrame]) -> SparkSession:
        """A session of its own in which same-named views stand for cleaned tables; this session keeps the raw ones."""
        own = self.spark.newSession()
        for t in self.user_tables():
            self.spark.table(t).createOrReplaceGlobalTempView(f"clean_{t}")
            own.table(f"global_temp.clean_{t}").createOrReplaceTempView(t)
        for name, df in views.items():
            df.createOrReplaceGlobalTempView(f"cleaned_{name}")
            own.table(f"global_temp.cleaned_{name}").createOrReplaceTempView(name)
        return own


def local_type(declared: str) -> str | None:
    """bigint, double or string of an external type; None if it is not copied."""
    d = declared.lower()
    if any(s in d for s in SKIPPED_TYPES):
        return None
    return "bigint" if any(s in d for s in ("int", "bit", "bool")) else "double" if any(s in d for s in ("decimal", "numeric", "double", "float", "real")) else "string"


def bit_value(c):
    """BIT bytes: up to 8 as a big-endian integer, longer ones as hex."""
    return F.when(F.length(c) <= 8, F.conv(F.hex(c), 16, 10)).otherwise(F.hex(c))


def imported(df: DataFrame, key: str | None, full: int = FULL_COPY, sample: int = SAMPLE) -> tuple[DataFrame, bool]:
    """The whole table up to ``full`` rows, else its newest ``sample`` rows by key; and whether it was cut.

    A limited count and a top-k: neither reads more into the driver than a number."""
    if df.limit(full + 1).count() <= full:
        return df, False
    return (df.orderBy(F.desc(key)) if key else df).limit(sample), True


#: Words of statements and functions that an external source never gets, and what opens a read-only session there.
DENIED = (
    "insert", "update", "delete", "merge", "truncate", "create", "alter", "drop", "grant", "revoke", "exec", "execute", "into", "load_file", "outfile", "dumpfile", "sleep", "pg_sleep", "pg_read_file", "xp_cmdshell", "attach", "pragma",
)
READ_ONLY = {"mysql": "SET SESSION TRANSACTION READ ONLY", "mariadb": "SET SESSION TRANSACTION READ ONLY", "postgresql": "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY", "oracle": "SET TRANSACTION READ ONLY"}


def checked_external(sql: str) -> str:
    """One SELECT or WITH without denied words outside literals and quoted names; else an error."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if not re.match(r"\s*(select|with)\b", bare, re.I) or ";" in bare.rstrip().rstrip(";"):
        raise ValueError("an external source is asked one SELECT at a time")
    if found := sorted({w for w in re.findall(r"[a-z_]+", bare.lower()) if w in DENIED}):
        raise ValueError(f"not for an external source: {', '.join(found)}")
    return sql


def external_options(url: str, table: str, columns: Sequence[str], properties: dict | None = None) -> dict:
    """Options of a JDBC read: one checked SELECT, in a session that is read-only where the database knows such sessions."""
    if not re.fullmatch(r"[\w$.]+", table) or not all(re.fullmatch(r"[\w$]+", c) for c in columns):
        raise ValueError("tables and columns are plain names")
    kind = url.removeprefix("jdbc:").partition(":")[0].lower()
    own = {"sessionInitStatement": READ_ONLY[kind]} if kind in READ_ONLY else {}
    return {"url": url, "query": checked_external(f"SELECT {', '.join(columns)} FROM {table}"), **own, **(properties or {})}


def read_external(spark: SparkSession, url: str, table: str, columns: Sequence[tuple[str, str]], properties: dict | None = None) -> DataFrame:
    """A JDBC table with local types; columns that are not copied are null."""
    kept = [(c, local_type(t)) for c, t in columns]
    df = spark.read.format("jdbc").options(**external_options(url, table, [c for c, t in kept if t], properties)).load()
    return df.select(*(df[c].cast(t).alias(c) if t else F.lit(None).cast("string").alias(c) for c, t in kept))


def field_documentation(spark: SparkSession, tables: Sequence[str]) -> DataFrame | None:
    """(table_name, column_name, text) from the first table that documents columns; the first text of each column."""
    for t in tables:
        df = spark.table(t)
        real = {c.lower(): c for c in df.columns}
        text = next((real[c] for c in ("documentation", "description", "comment", "remark", "column_comment") if c in real), None)
        if "table_name" in real and "column_name" in real and text:
            return df.where(F.col(text).isNotNull()).groupBy(F.col(real["table_name"]).alias("table_name"), F.col(real["column_name"]).alias("column_name")).agg(F.min(text).alias("text"))
    return None


def deleted_share(df: DataFrame, column: str) -> DataFrame:
    from plumbline.operators.keys import live

    return df.agg(F.round(F.avg(F.when(live(column), 0.0).otherwise(1.0)), 4).alias("deleted_share"))


def data_profile(df: DataFrame, name: str, key: str, marked, time_column: str | None = None) -> DataFrame:
    """What the data of a table tell: rows, whether the key identifies them, the share of marked (say, deleted) rows, first and last day."""
    day = lambda f: f(F.to_date(time_column)).cast("string") if time_column else F.lit(None).cast("string")
    return df.agg(
        F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), (F.count_distinct(key) == F.count(F.lit(1))).alias("keyed"), F.round(F.avg(F.when(marked, 1.0).otherwise(0.0)), 4).alias("marked_share"),
        day(F.min).alias("first_day"), day(F.max).alias("last_day"),
    )


def source_profile(schema: dict[str, Sequence[tuple[str, str]]]) -> dict:
    """What names tell of a database: soft-delete and audit columns, polymorphic keys, hubs, shards, scratch tables."""
    columns = {t: [c.lower() for c, _ in cs] for t, cs in schema.items()}
    counts: dict[str, int] = {}
    for cs in columns.values():
        for c in set(cs):
            counts[c] = counts.get(c, 0) + 1
    n = max(1, len(columns))
    return {
        "soft_delete": {t: c for t, cs in columns.items() for c in cs if re.fullmatch(r"(is_?)?del(eted?)?(_?flag)?|del_?flag", c)},
        "audit": sorted(c for c in counts if re.fullmatch(r"(create|update|insert|modify)(d)?_(time|at|by|user|date)", c)),
        "polymorphic": sorted({(t, a, b) for t, cs in columns.items() for a in cs for b in cs if a.endswith("_type") and b in (a[:-5] + "_id", a[:-5] + "_no", a[:-5] + "_code")}),
        "hubs": sorted(c for c, k in counts.items() if re.search(r"_(id|no|code)$", c) and len(columns) >= 10 and k >= 0.2 * n),
        "envelope": sorted(c for c, k in counts.items() if len(columns) >= 5 and k >= 0.2 * n and not re.search(r"_(id|no|code)$", c)),
        "shards": sorted(t for t in columns if re.search(r"_(19|20)\d{2}(\d{2})?$", t)),
        "scratch": sorted(t for t in columns if re.search(r"(^|_)(tmp|temp|bak|backup|test|copy)(_|$)", t)),
    }


def read_rest(spark: SparkSession, payload: str) -> DataFrame:
    """Records of a JSON answer (a list, or an object with one list) as a table; nested values as JSON text."""
    data = json.loads(payload)
    rows = data if isinstance(data, list) else next((v for v in data.values() if isinstance(v, list)), [data])
    names = list(dict.fromkeys(k for r in rows for k in r))
    flat = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(flat(r.get(n)) for n in names) for r in rows], schema)


def _pointer(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(df: DataFrame, path: str, kind: str = "parquet", keep: int = 2) -> None:
    """Writes a version of its own below ``path``, then puts a pointer to it in the old pointer's place by one rename: ``load`` finds
    the old version or the new one, whole, at any time. The newest ``keep`` versions stay, for readers that have begun."""
    spark, version = df.sparkSession, f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.format(kind).save(f"{path}/{version}")
    jvm, pointer, fs = _pointer(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/_next-{version}")
    out = fs.create(new, True)
    out.write(bytearray(f"{kind} {version}".encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(new, pointer, overwrite)
    versions = sorted(f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.isDirectory() and f.getPath().getName().startswith("v-"))
    for old in versions[: max(0, len(versions) - keep)]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The version that ``save`` has last put in place."""
    jvm, pointer, fs = _pointer(spark, path)
    stream = fs.open(pointer)
    kind, _, version = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").partition(" ")
    stream.close()
    return spark.read.format(kind).load(f"{path}/{version}")


def save_field_profile(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """The profile of columns as one CSV with a header."""
    from plumbline.operators.profile import columns_profile

    columns_profile(df, columns).orderBy("column_name").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    df.write.mode("append").json(path)
