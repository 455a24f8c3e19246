"""Upserts on plain tables: each takes the present table and what comes in, and returns the table as it is afterwards.

Conflicts are settled by one aggregation or one outer join on the key, so a batch of any size costs one shuffle of both sides.
Within a batch the last row of a key wins (by ``order``), except where the first write wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a task gets, about, when a table is dealt out by a key.
EACH = 500_000


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an order that tells rows apart. An aggregation: combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[c if c in keys else F.col("_r")[c].alias(c) for c in rows.columns])


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], update: list[str], rule: dict[str, Column] | None = None) -> DataFrame:
    """current with incoming (one row per key): new keys are added, of known ones the columns ``update`` are replaced.

    rule gives expressions for columns of known keys instead, over ``cur`` and ``inc``. Adds ``created``.
    """
    rule = rule or {}
    cur = current.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("cur"))
    inc = incoming.select(*keys, F.struct(*[c for c in current.columns if c not in keys]).alias("inc"))
    out = []
    for c in current.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        known = rule[c] if c in rule else F.col("inc" if c in update else "cur")[c]
        value = F.when(F.col("inc").isNull(), F.col("cur")[c]).when(F.col("cur").isNull(), F.col("inc")[c])
        out.append(value.otherwise(known).alias(c))
    return cur.join(inc, keys, "full_outer").select(*out, F.col("cur").isNull().alias("created"))


def upsert_artifacts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Artifacts by (source_system, source_external_id).

    Where the raw source hasn't changed, summary, status and error stay; else the summary is the incoming one or none,
    the status pending and the error cleared. type and user_id are never changed.
    """
    same = F.col("cur.raw_source").eqNullSafe(F.col("inc.raw_source"))
    keys = ["source_system", "source_external_id"]
    fixed = {*keys, "type", "user_id", "summary", "processing_status", "last_error"}
    return upsert(
        current,
        incoming,
        keys,
        [c for c in current.columns if c not in fixed],
        {
            "summary": F.when(same, F.col("cur.summary")).otherwise(F.col("inc.summary")),
            "processing_status": F.when(same, F.col("cur.processing_status")).otherwise("pending"),
            "last_error": F.when(same, F.col("cur.last_error")),
        },
    )


def parts(rows: DataFrame) -> int:
    """Partitions of about ``EACH`` rows. For joins by key, whose tasks sort what they get: left to itself, Spark puts partitions together
    by their compressed size, some millions of rows of a few columns. It is the keys' side that is to be dealt out by it; Spark deals the
    other side alike, but would move a repartition of the rows themselves behind a semi or anti join."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // EACH))


def replace_children(current: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """All children of the incoming parents are replaced."""
    return clear_children(current, incoming, parent).unionByName(incoming)


def clear_children(current: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """All children of the named parents go; a null names nothing."""
    gone = parents.select(parent).repartition(parts(current), parent).distinct()
    return current.join(gone, parent, "left_anti").select(*current.columns)


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First write wins: rows of known keys, and later rows of a key, do nothing."""
    new = first_per_key(incoming, keys, order)
    return current.unionByName(new.join(current.select(*keys), keys, "left_anti"))


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """An update: columns get values in the rows where the condition holds."""
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_from(df: DataFrame, other: DataFrame, key: str, columns: list[str], guard: Column | None = None) -> DataFrame:
    """Columns of the rows that other (one row per key) names are replaced, where guard holds."""
    new = other.select(key, F.struct(*columns).alias("_new"))
    holds = F.col("_new").isNotNull() if guard is None else F.col("_new").isNotNull() & guard
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.when(holds, F.col("_new")[c]).otherwise(F.col(c)) for c in columns}).select(*df.columns)


def reset_errors(artifacts: DataFrame) -> DataFrame:
    """Artifacts in error, or left in processing, are pending again."""
    return set_where(artifacts, F.col("processing_status").isin("error", "processing"), processing_status="pending")


def tri_state(old: Column, given: Column, value: Column) -> Column:
    """An update where a column may be left out (stays), be null (cleared) or have a value."""
    return F.when(given, value).otherwise(old)


def resolve_parents(tasks: DataFrame, key: str = "task_id", parent: str = "parent_external_id", external: str = "external_id") -> DataFrame:
    """tasks with parent_task_id: that of the task whose external id is the parent's; others keep theirs."""
    ids = tasks.select(F.col(external).alias(parent), F.col(key).alias("_found")).dropDuplicates([parent])
    joined = tasks.join(ids, parent, "left")
    changed = F.col("_found").isNotNull() & ~F.col("parent_task_id").eqNullSafe(F.col("_found"))
    return joined.withColumn("parent_task_id", F.when(changed, F.col("_found")).otherwise(F.col("parent_task_id"))).select(*tasks.columns)
