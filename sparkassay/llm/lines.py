"""Cross-site boilerplate lines, found by their spread over distinct sites.

A line is *shared* when it stands on at least ``min_sites`` distinct sites. Shared lines are boilerplate or parts of copied
documents, and the documents tell which: a document is a *witness* when lines that are not shared make up at least
``own_percent`` of the characters of its lines. A shared line is boilerplate when its witnesses lie on at least
``min_sites`` distinct sites. A copied or nearly copied document consists of shared lines and is no witness, so copies
neither make their own lines boilerplate nor protect a footer, however many there are.

Spreads are HyperLogLog sketches per line hash, merged by aggregation. A line whose estimate is clearly on one side is
decided by it; a line near the threshold gets an exact distinct count. All of it is DataFrame work: a hot line or site is
combined before the shuffle, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.session import durable, small_side

from .names import fresh

MIN_SITES = 8
OWN_PERCENT = 50
BAND = 0.25
LG_NOMINAL = 12


def _split(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _row_key(df: DataFrame, key: str, text: str, site: str) -> list[Column]:
    """96 bits that tell rows apart; equal rows share them, and have the same lines to remove."""
    cols = [F.col(c).cast("string") for c in (key, site, text)]
    told = [F.coalesce(c, F.lit("\0")) for c in cols]
    return [F.xxhash64(*told).alias("k1"), F.hash(*reversed(told)).alias("k2")]


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """One row per line with a word: row key, site, characters of all such lines of the row, place, line hash and length."""
    each = F.transform(
        _split(text),
        lambda x, i: F.struct(
            i.alias("place"), F.xxhash64(x).alias("h"), F.length(x).alias("n"), x.rlike(r"[^ \t-\r]").alias("word")
        ),
    )
    worded = F.transform(F.array(each), lambda every: F.filter(every, lambda x: x["word"]))[0]
    told = docs.select(*_row_key(docs, key, text, site), F.col(site).cast("string").alias("site"), worded.alias("every"))
    total = F.aggregate("every", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    told = told.select("*", total.alias("total"))  # before the explosion, so that rows carry the number and not the lines
    out = told.select("k1", "k2", "site", "total", F.explode("every").alias("one"))
    return out.select("k1", "k2", "site", "total", "one.place", "one.h", "one.n")


def spread(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, n) of the lines of ``found`` on at least ``min_sites`` distinct sites. A null site is no site."""
    sketched = (
        found.groupBy("h", "n")
        .agg(F.count(F.lit(1)).alias("times"), F.hll_sketch_agg("site", F.lit(LG_NOMINAL)).alias("sites"))
        .filter(F.col("times") >= min_sites)
        .select("h", "n", F.hll_sketch_estimate("sites").alias("sites"))
        .filter(F.col("sites") >= min_sites * (1 - BAND))
    )
    sketched = durable(sketched.select("h", "n", (F.col("sites") > min_sites * (1 + BAND)).alias("above")))
    near = sketched.filter("not above").select("h", "n")
    # The few near lines are met before any shuffle; equal (line, site) rows are combined within each map task.
    kinds = found.select("h", "n", "site").join(small_side(near), ["h", "n"]).distinct()
    exact = kinds.groupBy("h", "n").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return sketched.filter("above").select("h", "n").unionByName(exact.select("h", "n"))


def remove_boilerplate(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    site: str = "source",
    min_sites: int = MIN_SITES,
    own_percent: int = OWN_PERCENT,
    report: bool = False,
) -> DataFrame:
    """``docs`` without boilerplate lines; every row stays, a null text stays null.

    Lines are cut at line feeds; blank lines are never boilerplate. Equal rows lose equal lines, and ties do not arise: a
    line goes wherever it stands, in witnesses and in other documents. The work of a text is linear in its length and
    lines. With ``report`` the columns ``n_lines`` and ``n_removed`` (long) follow; an input column of that name is
    replaced.
    """
    found = occurrences(docs, key, text, site)
    shared = durable(spread(found, min_sites))
    # Shared lines by document, each place once: bounded by the lines of one text.
    marked = (
        found.join(small_side(shared), ["h", "n"])
        .groupBy("k1", "k2")
        .agg(F.max("site").alias("site"), F.max("total").alias("total"), F.collect_set(F.struct("place", "h", "n")).alias("held"))
    )
    marked = durable(marked)
    held = F.aggregate("held", F.lit(0).cast("long"), lambda t, x: t + x["n"])
    witness = 100 * (F.col("total") - held) >= own_percent * F.col("total")
    witnessed = marked.filter(witness).select("site", F.inline("held"))
    bad = durable(spread(witnessed, min_sites))
    drop = (
        marked.select("k1", "k2", F.inline("held"))
        .join(small_side(bad), ["h", "n"])
        .groupBy("k1", "k2")
        .agg(F.collect_list("place").alias("drop"))
    )
    k1, k2, gone = fresh(docs, "k1", "k2", "drop")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_row_key(docs, key, text, site), (k1, k2))])
    drop = drop.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("drop").alias(gone))
    joined = keyed.join(drop, [k1, k2], "left")

    def rest(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))  # by hash, in order
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    # The one-element array binds the lines once, instead of splitting the text again for every place.
    cleaned = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.transform(F.array(_split(text)), rest)[0])
    more = []
    if report:
        more = [
            F.size(_split(text)).cast("long").alias("n_lines"),
            F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        ]
    same = [c for c in docs.columns if not (report and c.lower() in ("n_lines", "n_removed"))]
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in same], *more)
