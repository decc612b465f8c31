"""Evidence about keys: canonical values, overlap, uniqueness, orphans, and what follows from them.

Every function takes whole tables and aggregates before it joins: a key's rows are counted first, so that a
hot key is one row of a join. Counts are exact; a verdict never rests on an approximation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers of a live row in a soft-delete column, NULL apart.
LIVE_MARKERS = ("0", "N", "n", "false", "")
#: Thresholds of the verdicts.
VERIFIED_OVERLAP, WEAK_FLOOR, MIN_DISTINCT, NEAR_UNIQUE = 60.0, 20.0, 3, 0.95
ADAPTIVE_KNEE, ADAPTIVE_FLOOR = 50, 50.0


def columns_of(df: DataFrame, key: str | Sequence[str]) -> list[str]:
    """Real spellings of a key's columns: 1 to 32 distinct ones, found without regard to case."""
    names = [c.strip() for c in key.split(",")] if isinstance(key, str) else list(key)
    real = {c.lower(): c for c in df.columns}
    if not 1 <= len(names) <= 32 or len({c.lower() for c in names}) != len(names) or not all(names):
        raise ValueError(f"a key has 1 to 32 distinct columns: {names}")
    missing = [c for c in names if c.lower() not in real]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    return [real[c.lower()] for c in names]


def canonical(df: DataFrame, column: str) -> Column:
    """A key value as text: integers and integral reals without a point, other values trimmed."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.IntegralType):
        return c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < 9.2e18), d.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return F.trim(c.cast("string"))


def present(df: DataFrame, key: Sequence[str]) -> Column:
    """No component is null or empty."""
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in key))


def key_values(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """k1, k2, ... of rows whose key is present, in canonical form."""
    names = columns_of(df, key)
    return df.where(present(df, names)).select(*(canonical(df, c).alias(f"k{i}") for i, c in enumerate(names)))


def live(column: str | Column) -> Column:
    """Not marked as deleted."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | c.cast("string").isin(*LIVE_MARKERS)


def relation_signals(child: DataFrame, child_key, parent: DataFrame, parent_key) -> DataFrame:
    """One row of evidence: overlap (percent, -1 without child values), distinct counts and matches, rows, uniqueness.

    Both sides are reduced to (key, rows) first; one full join of distinct keys gives every number. Uniqueness
    counts all rows, so a null or empty key makes a side non-unique.
    """
    n = len(columns_of(child, child_key))
    if n != len(columns_of(parent, parent_key)):
        raise ValueError("keys have different numbers of columns")
    keys = [f"k{i}" for i in range(n)]
    left = key_values(child, child_key).groupBy(*keys).agg(F.lit(1).alias("c"))
    right = key_values(parent, parent_key).groupBy(*keys).agg(F.lit(1).alias("p"))
    seen = left.join(right, keys, "full").agg(F.count("c").alias("child_distinct"), F.count("p").alias("parent_distinct"), F.count(F.when(F.col("c").isNotNull() & F.col("p").isNotNull(), 1)).alias("matched_distinct"))
    rows = child.agg(F.count(F.lit(1)).alias("child_rows")).join(parent.agg(F.count(F.lit(1)).alias("parent_rows")))
    overlap = F.when(F.col("child_distinct") > 0, 100.0 * F.col("matched_distinct") / F.col("child_distinct")).otherwise(-1.0)
    return seen.join(rows).select(
        overlap.alias("overlap"), "child_distinct", "parent_distinct", "matched_distinct", "child_rows", "parent_rows",
        (F.col("child_distinct") == F.col("child_rows")).alias("child_unique"), (F.col("parent_distinct") == F.col("parent_rows")).alias("parent_unique"),
        F.lit(True).alias("evidence_complete"), F.lit("exact").alias("evidence_method"),
    )


def batched_signals(tables: dict[str, DataFrame], candidates: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Evidence of many single-column candidates (child, child_key, parent, parent_key) in one job.

    Each key column is read and counted once, however many candidates name it; the candidates, a small table
    of names, tell which values are compared."""
    spark = next(iter(tables.values())).sparkSession
    need: dict[str, list[str]] = {}
    for ct, ck, pt, pk in candidates:
        for t, k in ((ct, ck), (pt, pk)):
            c = columns_of(tables[t], k)[0]
            if c not in need.setdefault(t, []):
                need[t].append(c)
    # A column at a time: Parquet reads no other. All columns are one stage, whose tasks count a value's rows before they send it.
    number = {x: n for n, x in enumerate((t, c) for t, cols in need.items() for c in cols)}
    parts = [tables[t].select(F.lit(n).alias("c"), F.when(F.col(c).cast("string") != "", canonical(tables[t], c)).alias("v")) for (t, c), n in number.items()]
    values = reduce(DataFrame.unionByName, parts).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    named = [(i, ct, columns_of(tables[ct], ck)[0], pt, columns_of(tables[pt], pk)[0]) for i, (ct, ck, pt, pk) in enumerate(candidates)]
    roles = [r for i, ct, ck, pt, pk in named for r in ((i, number[ct, ck], "c"), (i, number[pt, pk], "p"))]
    sides = values.join(F.broadcast(spark.createDataFrame(roles, "i int, c int, role string")), "c")
    child, parent = F.col("role") == "c", F.col("role") == "p"
    met = sides.groupBy("i", "v").agg(F.sum(F.when(child, F.col("n"))).alias("cn"), F.sum(F.when(parent, F.col("n"))).alias("pn"))  # a value, and its rows on either side
    has = lambda x: F.col("v").isNotNull() & F.col(x).isNotNull()
    found = met.groupBy("i").agg(
        F.count_if(has("cn")).alias("child_distinct"), F.count_if(has("pn")).alias("parent_distinct"), F.count_if(has("cn") & has("pn")).alias("matched_distinct"), F.coalesce(F.sum("cn"), F.lit(0)).alias("child_rows"), F.coalesce(F.sum("pn"), F.lit(0)).alias("parent_rows")
    )
    out = spark.createDataFrame(named, "i int, child string, child_key string, parent string, parent_key string").join(found, "i", "left").fillna(0)
    return out.select(
        "child", "child_key", "parent", "parent_key", F.when(F.col("child_distinct") > 0, 100.0 * F.col("matched_distinct") / F.col("child_distinct")).otherwise(-1.0).alias("overlap"),
        "child_distinct", "parent_distinct", "matched_distinct", "child_rows", "parent_rows",
        (F.col("child_distinct") == F.col("child_rows")).alias("child_unique"), (F.col("parent_distinct") == F.col("parent_rows")).alias("parent_unique"),
    )


def verdicts(evidence: DataFrame, name_ok: Column | bool = True, child_is_key: Column | bool = False, theta: Column | float = VERIFIED_OVERLAP, min_distinct: int = MIN_DISTINCT, weak_floor: float = WEAK_FLOOR) -> DataFrame:
    """Adds status (verified, candidate, drop) and reason to rows of evidence."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    o, d, named = F.col("overlap"), F.col("child_distinct"), as_col(name_ok)
    strong = (o >= as_col(theta)) & F.col("parent_unique")
    reason = (
        F.when(as_col(child_is_key), "child_is_key").when(d < min_distinct, "few_values").when(o.isNull() | F.isnan(o) | (o < 0) | (o > 100), "invalid_overlap")
        .when(strong & named & (d == 1), "single_value").when(strong & named, "proven").when(strong, "name_mismatch").when(o >= weak_floor, "weak_overlap").otherwise("low_overlap")
    )
    status = F.when(F.col("reason") == "proven", "verified").when(F.col("reason").isin("single_value", "name_mismatch", "weak_overlap"), "candidate").otherwise("drop")
    return evidence.withColumn("reason", reason).withColumn("status", status)


def adaptive_threshold(distinct: Column, base: float = VERIFIED_OVERLAP) -> Column:
    return F.when(distinct >= ADAPTIVE_KNEE, F.least(F.lit(base), F.lit(ADAPTIVE_FLOOR))).otherwise(base)


def direction(child_unique: Column, parent_unique: Column) -> Column:
    """Which side is the child: a->b, b->a, ambiguous (both unique) or none."""
    return F.when(child_unique & ~parent_unique, "b->a").when(parent_unique & ~child_unique, "a->b").when(child_unique & parent_unique, "ambiguous").otherwise("none")


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, rows, distinct, is_key of single columns, in one pass; a null makes a column no key."""
    stats = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_distinct(c).alias(c) for c in columns))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("_n").alias("n_rows"), F.col(c).alias("n_distinct"), (F.col(c) == F.col("_n")).alias("is_key")) for c in columns))).alias("x")).select("x.*")


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, high: float = 0.3) -> DataFrame:
    """rows with a key, orphan_rows, orphan_rate (3 decimals) and severity."""
    ck, pk = columns_of(child, child_key), columns_of(parent, parent_key)
    counted = key_values(child, ck).groupBy("k0").agg(F.count(F.lit(1)).alias("n"))
    missing = counted.join(key_values(parent, pk).select("k0").distinct().withColumn("_hit", F.lit(1)), "k0", "left")
    out = missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"))
    rate = F.round(F.coalesce(F.try_divide("orphan_rows", "n_rows"), F.lit(0.0)), 3)
    return out.withColumn("orphan_rate", rate).withColumn("severity", F.when(F.col("orphan_rate") > high, "high").otherwise("medium"))


def foreign_key_evidence(child: DataFrame, child_key, parent: DataFrame, parent_key) -> DataFrame:
    """A declared foreign key's validation: rows that refer, orphans, decision. Composite keys with a null refer to nothing."""
    ck, pk = columns_of(child, child_key), columns_of(parent, parent_key)
    names = [f"k{i}" for i in range(len(ck))]
    used = child.select(*(F.col(c).alias(k) for c, k in zip(ck, names, strict=True))).dropna()
    counted = used.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*(F.col(c).alias(k) for c, k in zip(pk, names, strict=True))).distinct().withColumn("_hit", F.lit(1))
    out = counted.join(known, names, "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("referencing_rows"), F.coalesce(F.sum(F.when(F.col("_hit").isNull(), F.col("n"))), F.lit(0)).alias("orphan_rows"))
    decision = F.when(F.col("referencing_rows") == 0, "declared_fk_no_referencing_rows").when(F.col("orphan_rows") > 0, "declared_fk_requires_review").otherwise("declared_fk_valid")
    return out.withColumn("decision", decision).withColumn("status", F.when(decision == "declared_fk_valid", "verified").otherwise("candidate"))


def conditional_overlap(child: DataFrame, discriminator: str, child_key: str, parents: dict[str, tuple[DataFrame, str]], min_values: int = 5) -> DataFrame:
    """Polymorphic keys: for each value of the discriminator the parent that matches most of its keys, with the match rate."""
    values = child.select(F.col(discriminator).cast("string").alias("kind"), canonical(child, child_key).alias("k")).dropna().distinct()
    hits = [values.join(key_values(p, pk).select(F.col("k0").alias("k")).distinct(), "k", "left_semi").groupBy("kind").agg(F.count(F.lit(1)).alias("matched")).withColumn("parent", F.lit(name)) for name, (p, pk) in parents.items()]
    total = values.groupBy("kind").agg(F.count(F.lit(1)).alias("keys")).where(F.col("keys") >= min_values)
    rate = reduce(DataFrame.unionByName, hits).join(total, "kind").withColumn("rate", F.round(100.0 * F.col("matched") / F.col("keys"), 2))
    best = rate.groupBy("kind").agg(F.max_by(F.struct("parent", "keys", "rate"), F.struct("rate", "parent")).alias("b"))
    return best.select("kind", "b.parent", "b.keys", "b.rate")


def latest(df: DataFrame, key: str | Sequence[str], time: str, tie: str | None = None) -> DataFrame:
    """The newest row of each key; ties go to the larger ``tie``."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [F.col(time).desc_nulls_last(), *([F.col(tie).desc_nulls_last()] if tie else [])]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def scoped_uniqueness(df: DataFrame, key: str, scope: str) -> DataFrame:
    """Is (scope, key) unique where the key alone is not (reused codes per tenant or group)?"""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"), F.count_distinct(F.struct(scope, key)).alias("n_scoped")).select(
        "n_rows", "n_keys", "n_scoped", (F.col("n_keys") == F.col("n_rows")).alias("key_unique"), (F.col("n_scoped") == F.col("n_rows")).alias("scoped_unique")
    )


def version_duplicates(df: DataFrame, key: str, has_time: bool = True, near: float = NEAR_UNIQUE) -> DataFrame:
    """Keys that are nearly unique: 0.95 n <= distinct < n hints at versions of rows, if there is a time to order them by."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")).select("n_rows", "n_keys", ((F.col("n_keys") < F.col("n_rows")) & (F.col("n_keys") >= near * F.col("n_rows")) & F.lit(has_time)).alias("versioned"))


def functional_dependency(df: DataFrame, category: str, value: str, min_rows: int = 10, share: float = 0.8) -> DataFrame:
    """Each category's most frequent value (ties to the smaller), rows, support and whether it is dominant."""
    counts = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(category).alias("category"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("category").agg(F.sum("n").alias("n_rows"), F.max("n").alias("kept"), F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("expected"))
    support = F.round(F.col("kept") / F.col("n_rows"), 3)
    return top.select("category", "expected", "n_rows", "kept", support.alias("support"), ((F.col("n_rows") >= min_rows) & (F.col("kept") >= share * F.col("n_rows"))).alias("dominant"))


def outliers(df: DataFrame, category: str, value: str, min_rows: int = 10, share: float = 0.8) -> DataFrame:
    """Values other than the expected one in categories with a dominant value, with their counts."""
    fd = functional_dependency(df, category, value, min_rows, share).where("dominant").select("category", "expected")
    counts = df.where(F.col(category).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(category).alias("category"), F.col(value).alias("outlier")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(fd, "category").where("outlier <> expected").select("category", "expected", "outlier", "n")


def recode(df: DataFrame, category: str, value: str, expected: DataFrame, guard: Column | None = None) -> DataFrame:
    """``value`` replaced by its category's expected one where ``guard`` holds; expected: (category, expected), one row each."""
    e = expected.select(F.col("category").alias("_c"), F.col("expected").alias("_e")).groupBy("_c").agg(F.min("_e").alias("_e"))
    new = F.when((guard if guard is not None else F.lit(True)) & F.col("_e").isNotNull(), F.col("_e")).otherwise(F.col(value))
    return df.join(e, F.col(category) == F.col("_c"), "left").withColumn(value, new).select(*df.columns)


def codebook_cover(df: DataFrame, column: str, codes: DataFrame, code: str, separator: str = ",") -> DataFrame:
    """Share of a (possibly multi-valued) column's values that a codebook has, weighted by rows."""
    parts = df.where(F.col(column).isNotNull()).select(F.explode(F.split(F.col(column).cast("string"), separator)).alias("v")).select(F.trim("v").alias("v")).where("v <> ''")
    counted = parts.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    known = codes.select(F.col(code).cast("string").alias("v")).distinct().withColumn("_hit", F.lit(1))
    return counted.join(known, "v", "left").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("_hit").isNotNull(), F.col("n"))), F.lit(0)).alias("n_known")).withColumn("cover", F.round(F.try_divide("n_known", "n_values"), 3))


def domain_difference(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """Values in the data that the codebook does not have, with their rows."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(codes.select(F.col(code).cast("string").alias("value")).distinct(), "value", "left_anti")
