"""Episode store operators on DataFrames: identity, de-duplication, selection and log merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, keyed
from . import designs
from .ordering import row_numbers
from .sequential import first_trials

UID = "ep_uid"
# Fixed value: the older name of the provenance column.
LEGACY_PROVENANCE = "label_mode"


def alias_legacy(df: DataFrame) -> DataFrame:
    if LEGACY_PROVENANCE in df.columns and "provenance" not in df.columns:
        return df.withColumnRenamed(LEGACY_PROVENANCE, "provenance")
    return df


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key; the rank filter is applied before the shuffle as well as after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def scan(df: DataFrame, scenario: str, order: list[str], scenario_col: str = "sc_name") -> DataFrame:
    """Episodes of one scenario, one row per uid (the first in store order)."""
    return keep_first(alias_legacy(df).where(F.col(scenario_col) == scenario), [UID], order)


def repeats(df: DataFrame) -> DataFrame:
    """Uids stored more than once: (ep_uid, extra)."""
    return df.groupBy(UID).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def validate(df: DataFrame, spaces, atol: float = 1e-8) -> DataFrame:
    """Episodes off the grid: (ep_uid, gidx, rule). The grid row is decoded from gidx, not joined."""
    names = designs.params(spaces)
    want = {n: c for n, c in zip(names, designs.decode(F.col("gidx"), spaces))}
    inside = F.coalesce(F.col("gidx").between(0, designs.grid_size(spaces) - 1), F.lit(False))
    differs = F.lit(False)
    for n in names:
        differs = differs | ~F.coalesce((F.abs(F.col(n) - want[n]) <= atol) & ~F.isnan(F.col(n)), F.lit(False))
    rule = F.when(~inside, "outside_grid").when(differs, "params_differ")
    return df.select(UID, "gidx", rule.alias("rule")).where("rule IS NOT NULL")


def content_digest(columns: list[str]) -> Column:
    """One hash over all named columns (JSON keeps NULL, NaN and nested values apart)."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def versions(df: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Number of rows and of different contents per uid."""
    body = [c for c in df.columns if c not in ignore]
    per = df.select(UID, content_digest(body).alias("_h")).groupBy(UID, "_h").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(UID).agg(F.count(F.lit(1)).alias("versions"), F.sum("_n").alias("rows"))


def conflicts(df: DataFrame, ignore: list[str] = ()) -> DataFrame:
    """Uids that carry more than one content."""
    return versions(df, ignore).where("versions > 1")


def conflict_files(df: DataFrame, file_col: str) -> DataFrame:
    """Where the conflicting uids are stored, one row per (uid, file)."""
    bad = conflicts(df, ignore=[file_col]).select(UID, "versions")
    return df.groupBy(UID, F.col(file_col).alias("file")).agg(F.count(F.lit(1)).alias("rows")).join(bad, UID)


def compact(df: DataFrame) -> DataFrame:
    """One row per identical (uid, content); callers refuse stores with ``conflicts`` first."""
    return df.dropDuplicates()


def digest_columns(columns: list[str]) -> list[Column]:
    """Aggregates that make an order-free digest of rows with these columns."""
    h = F.xxhash64(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))
    return [
        F.count(F.lit(1)).alias("rows"),
        F.sum(h.cast("decimal(38,0)")).alias("total"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("parity"),
    ]


def multiset_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table (one row), to prove that a rewritten copy holds the same rows."""
    return df.agg(*digest_columns(df.columns))


def screen(df: DataFrame) -> tuple[int, int]:
    """(hashes of uids, those whose rows differ by a hash of their contents).

    A row of the shuffle is three numbers, whatever the length of uids and contents. Hashes may be equal by chance: with
    no difference there are still conflicts where the distinct rows outnumber the hashes of uids.
    """
    hashed = df.select(F.xxhash64(UID).alias("_u"), F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias("_h"))
    per = hashed.groupBy("_u").agg((F.min("_h") != F.max("_h")).alias("_differ"))
    return tuple(per.agg(F.count(F.lit(1)), F.count_if("_differ")).first())


def merge_roots(roots: list[DataFrame], order: list[str]) -> DataFrame:
    """Several stores in priority order; a uid is kept from the first root that has it."""
    ranked = [alias_legacy(r).withColumn("root_rank", F.lit(i)) for i, r in enumerate(roots)]
    union = ranked[0]
    for r in ranked[1:]:
        union = union.unionByName(r, allowMissingColumns=True)
    return keep_first(union, [UID], ["root_rank", *order])


def batch_uid(batch: str, uid_from: list[str]) -> Column:
    """A uid that a retry of the batch reproduces."""
    return F.sha2(F.concat_ws("|", F.lit(batch), *[F.col(c).cast("string") for c in uid_from]), 256)


def unstored(rows: DataFrame, old: DataFrame, uid: Column) -> DataFrame:
    """Rows whose ``uid`` the store does not hold yet.

    Digests of 128 bits are compared first. Only where a batch is stored in part are its rows shuffled, and then once.
    """
    short = lambda c: F.unhex(F.md5(c)).alias("_k")
    fresh = rows.select(short(uid)).join(keyed(old.select(short(F.col(UID)))), "_k", "left_anti").count()
    if not fresh:
        return rows.where(F.lit(False))
    if fresh == rows.count():
        return rows
    named = rows.withColumn("_uid", uid)
    return durable(named.join(keyed(old.select(F.col(UID).alias("_uid"))), "_uid", "left_anti").drop("_uid"))


def number_new(rows: DataFrame, order: list[str], start: Column, batch: str, uid_from: list[str]) -> DataFrame:
    """Give new rows a progressive ``ep_id`` after ``start`` and a uid that a retry reproduces."""
    numbered = row_numbers(rows, [], order, "_pos")
    uid = batch_uid(batch, uid_from)
    return numbered.withColumn("ep_id", (start + F.col("_pos")).cast("bigint")).withColumn(UID, uid).drop("_pos")


def merge_log(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key the log does not hold yet."""
    return new.join(old.select(*keys), keys, "left_anti")


def design_counts(df: DataFrame, consumed: DataFrame) -> DataFrame:
    used = consumed.select(UID).distinct().withColumn("_used", F.lit(True))
    return df.join(used, UID, "left").groupBy("gidx").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_used").isNull()).alias("n_unconsumed")
    )


def fifo_take(df: DataFrame, consumed: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """First ``limit`` episodes per design that were not handed out before."""
    fresh = df.join(consumed.select(UID), UID, "left_anti")
    return first_trials(fresh, keys, order, limit)
