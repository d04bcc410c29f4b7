"""Splits, prediction metrics, calibration and selection over documents, labels and lineitem scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions import violation as V
from sparkassay.operators import metrics as M
from sparkassay.operators import selection as S
from sparkassay.operators import splits as SP

from .adapters import table
from .audit import HASH
from .payloads import MARGIN_SQL, margins
from .rare import rounded
from .registry import query


def part_labels(spark, sf):
    """A part is unsafe when its mean quantity exceeds 26."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gidx"))
    return li.agg((F.avg("l_quantity") <= 26).cast("int").alias("label"))


LABEL_SQL = "lb AS (SELECT l_partkey AS gidx, (avg(l_quantity) <= 26)::INT AS label FROM lineitem GROUP BY 1)"
SPLIT_SQL = f"""{LABEL_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH.format("'13:' || gidx")}, gidx) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM lb),
fl AS (SELECT *, floor(n * 0.25::DOUBLE) AS f0, floor(n * 0.15::DOUBLE) AS f1, floor(n * 0.6::DOUBLE) AS f2 FROM rk),
fr AS (SELECT *, n * 0.25::DOUBLE - f0 AS r0, n * 0.15::DOUBLE - f1 AS r1, n * 0.6::DOUBLE - f2 AS r2, n - (f0 + f1 + f2) AS rest FROM fl),
cn AS (SELECT *, f0 + (((r1 > r0)::INT + (r2 > r0)::INT) < rest)::INT AS c0, f1 + (((r0 >= r1)::INT + (r2 > r1)::INT) < rest)::INT AS c1 FROM fr),
sp AS (SELECT gidx, label, CASE WHEN rn <= c0 THEN 'calib' WHEN rn <= c0 + c1 THEN 'test' ELSE 'train' END AS split FROM cn)"""


def split(spark, sf):
    return SP.stratified_split(part_labels(spark, sf), 0.25, 0.15, 13)


@query("stratified_split", f"WITH {SPLIT_SQL} SELECT gidx, label, split FROM sp")
def stratified_split(spark, sf):
    return split(spark, sf)


@query("split_labels_filter", f"WITH {SPLIT_SQL} SELECT gidx, label FROM sp WHERE split = 'train'")
def split_labels_filter(spark, sf):
    return SP.split_labels_filter(part_labels(spark, sf), split(spark, sf).drop("label"), "train")


@query(
    "split_membership",
    f"""WITH {SPLIT_SQL} SELECT split, l_linestatus AS scenario, count(*) AS n, round(sum(l_extendedprice), 2) AS metric_sum
FROM lineitem JOIN sp ON gidx = l_partkey GROUP BY ALL""",
)
def split_membership(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "gidx")
    rows = SP.split_membership(li, split(spark, sf))
    return rows.groupBy("split", F.col("l_linestatus").alias("scenario")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("metric_sum")
    )


@query(
    "split_check",
    f"""WITH {SPLIT_SQL}, s2 AS (SELECT gidx FROM sp WHERE gidx % 7 <> 0 UNION ALL SELECT gidx FROM sp WHERE gidx % 10 = 3),
l2 AS (SELECT gidx FROM lb WHERE gidx % 11 <> 5)
SELECT 'in_two_splits' AS rule, gidx FROM s2 GROUP BY gidx HAVING count(*) > 1
UNION ALL SELECT 'label_without_split', gidx FROM l2 WHERE gidx NOT IN (SELECT gidx FROM s2)
UNION ALL SELECT DISTINCT 'split_without_label', gidx FROM s2 WHERE gidx NOT IN (SELECT gidx FROM l2)
UNION ALL SELECT 'outside_grid', gidx FROM (SELECT gidx FROM s2 UNION SELECT gidx FROM l2) WHERE gidx >= 1900
UNION ALL SELECT 'label_not_binary', gidx FROM l2 WHERE gidx % 13 = 4""",
)
def split_check(spark, sf):
    sp = split(spark, sf)
    twice = sp.where("gidx % 7 <> 0").unionByName(sp.where("gidx % 10 = 3"))
    lab = part_labels(spark, sf).where("gidx % 11 <> 5")
    odd = lab.withColumn("label", F.when(F.col("gidx") % 13 == 4, 2).otherwise(F.col("label")))
    return SP.split_check(twice, odd, 1900)


# quality labels of documents scored by their length
SCORED_SQL = """sc AS (SELECT lang, quality AS y, 1 / (1 + exp(-(n_chars - 1500) / 1000.0)) AS p FROM labels JOIN documents USING (doc_id)),
li AS (SELECT l_suppkey AS gidx, (l_quantity > 25)::INT AS y, round(0.02 + l_discount * 5 + l_tax * 5, 3) AS p FROM lineitem)"""


def scored(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    p = 1 / (1 + F.exp(-(F.col("n_chars") - 1500) / 1000.0))
    return docs.join(table(spark, sf, "labels"), "doc_id").select("lang", F.col("quality").alias("y"), p.alias("p"))


def scored_rows(spark, sf):
    p = F.round(0.02 + F.col("l_discount") * 5 + F.col("l_tax") * 5, 3)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("gidx"), (F.col("l_quantity") > 25).cast("int").alias("y"), p.alias("p")
    )


def auc_sql(src: str, key: str) -> str:
    return f"""g AS (SELECT {key}, count(*) AS n, sum(y) AS pos, avg(y) AS rate, avg(((p >= 0.5)::INT = y)::INT) AS acc,
  avg(-(y * ln(least(1 - 1e-6, greatest(1e-6, p))) + (1 - y) * ln(1 - least(1 - 1e-6, greatest(1e-6, p))))) AS ll FROM {src} GROUP BY {key}),
d AS (SELECT {key}, p, sum(y) AS sp, sum(1 - y) AS sn FROM {src} GROUP BY ALL),
c AS (SELECT *, coalesce(sum(sn) OVER (PARTITION BY {key} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM d),
w AS (SELECT {key}, sum(sp * (nb + sn / 2)) AS wins FROM c GROUP BY {key})
SELECT {key}, n, CASE WHEN pos > 0 AND pos < n THEN round(ll, 9) END AS logloss, round(acc, 9) AS accuracy,
  CASE WHEN pos > 0 AND pos < n THEN round(wins / (pos * (n - pos)), 9) END AS auc, round(rate, 9) AS rate FROM g JOIN w USING ({key})"""


CLASS_ROUND = {"logloss": 9, "accuracy": 9, "auc": 9, "rate": 9}


@query("classification_metrics", f"WITH {SCORED_SQL}, {auc_sql('li', 'gidx')}")
def classification_metrics(spark, sf):
    return rounded(M.classification_metrics(scored_rows(spark, sf), ["gidx"]), CLASS_ROUND)


@query("document_metrics", f"WITH {SCORED_SQL}, {auc_sql('sc', 'lang')}")
def document_metrics(spark, sf):
    return rounded(M.classification_metrics(scored(spark, sf), ["lang"]), CLASS_ROUND)


@query(
    "regression_metrics",
    """SELECT l_suppkey AS gidx, round(sqrt(avg((l_extendedprice / 2000 - l_quantity) ** 2)), 6) AS rmse,
  round(avg(abs(l_extendedprice / 2000 - l_quantity)), 6) AS mae FROM lineitem GROUP BY 1""",
)
def regression_metrics(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("gidx"), (F.col("l_extendedprice") / 2000).alias("pred"), F.col("l_quantity").alias("y")
    )
    return rounded(M.regression_metrics(li, ["gidx"]), {"rmse": 6, "mae": 6})


QS = list(M.CALIB_QUANTILES)


@query(
    "quantile_deltas",
    f"""WITH b AS (SELECT l_quantity AS y, 20 + l_discount * 100 + l_tax * 50 AS base FROM lineitem), q AS (SELECT unnest({QS})::DOUBLE AS q),
r AS (SELECT q, y, base * (0.5 + q) AS pred FROM b, q), d AS ({' UNION ALL '.join(f'SELECT {q}::DOUBLE AS q, quantile_cont(y - pred, {q}) AS delta FROM r WHERE q = {q}::DOUBLE' for q in QS)})
SELECT q, round(any_value(delta), 6) AS delta, round(avg((y <= pred)::INT), 9) AS cov_pre, round(avg((y <= pred + delta)::INT), 3) AS cov_post
FROM r JOIN d USING (q) GROUP BY q""",
)
def quantile_deltas(spark, sf):
    base = 20 + F.col("l_discount") * 100 + F.col("l_tax") * 50
    levels = F.explode(F.array(*[F.lit(q) for q in QS]))
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), base.alias("b"), levels.alias("q"))
    out = M.quantile_deltas(rows.select("q", "y", (F.col("b") * (0.5 + F.col("q"))).alias("pred")))
    return rounded(out, {"delta": 6, "cov_pre": 9, "cov_post": 3})


def predicted(spark, sf):
    """A rough margin model per part: mean from the part number, variance from the retail price."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("gidx"),
        (F.col("p_size") / 20 + 0.8).alias("mu"),
        (F.col("p_retailprice") / 700).alias("var"),
    )


CAL_SQL = """mg AS (SELECT l_partkey AS gidx, l_quantity / 10 - 0.5 AS margin FROM lineitem),
pr AS (SELECT p_partkey AS gidx, p_size / 20 + 0.8 AS mu, p_retailprice / 700 AS var FROM part),
bi AS (SELECT quantile_cont(d, 0.5) AS bias FROM (SELECT avg(margin) - any_value(mu) AS d FROM mg JOIN pr USING (gidx) GROUP BY gidx)),
ra AS (SELECT (margin - mu - bias) ** 2 / ({z} ** 2 * var * {f}) AS r FROM mg JOIN pr USING (gidx), bi),
sc AS (SELECT r AS scale FROM ra QUALIFY row_number() OVER (ORDER BY r) = ceil(0.9::DOUBLE * count(*) OVER ()))
SELECT round((SELECT bias FROM bi), 6) AS bias, round((SELECT scale FROM sc), 6) AS scale,
  round(avg((r <= (SELECT scale FROM sc) * (1 + 1e-12))::INT), 4) AS coverage, count(*) AS n FROM ra"""


def part_margins(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gidx"), (F.col("l_quantity") / 10 - 0.5).alias("margin")
    )


@query("margin_coverage_calibration", "WITH " + CAL_SQL.format(z=repr(M.two_sided_quantile(0.9)), f=1))
def margin_coverage_calibration(spark, sf):
    out = M.margin_coverage_calibration(predicted(spark, sf), part_margins(spark, sf), 0.9)
    return rounded(out, {"bias": 6, "scale": 6, "coverage": 4})


@query("margin_coverage_student_t", "WITH " + CAL_SQL.format(z=repr(M.two_sided_quantile(0.9, "student_t", 5.0)), f="0.6"))
def margin_coverage_student_t(spark, sf):
    out = M.margin_coverage_calibration(predicted(spark, sf), part_margins(spark, sf), 0.9, "student_t", 5.0)
    return rounded(out, {"bias": 6, "scale": 6, "coverage": 4})


XS, YS = [0.05, 0.2, 0.5, 0.7], [0.02, 0.3, 0.45, 0.9]


@query(
    "p_calibrate",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS p FROM lineitem),
c AS (SELECT *, CASE WHEN p <= 0.05 THEN 0.02 WHEN p >= 0.7 THEN 0.9 WHEN p <= 0.2 THEN 0.02 + (p - 0.05) / 0.15 * 0.28
  WHEN p <= 0.5 THEN 0.3 + (p - 0.2) / 0.3 * 0.15 ELSE 0.45 + (p - 0.5) / 0.2 * 0.45 END AS k FROM x),
t AS (SELECT *, CASE WHEN k < 0.1 THEN least(1, 1.5 * k ** 0.5) ELSE k END AS k2 FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, round(least(1, greatest(0, greatest(k2, p))), 9) AS p FROM t""",
)
def p_calibrate(spark, sf):
    p = M.p_calibrate(F.col("l_quantity") / 50, XS, YS, tail_alpha=1.5, tail_power=2.0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(p, 9).alias("p"))


@query(
    "temperature_scale",
    f"""WITH {SCORED_SQL}, t AS (SELECT unnest(range(0, 30)) AS i, 0.5 + unnest(range(0, 30)) * 4.5 / 29 AS temp),
x AS (SELECT gidx, i, temp, y, 1 / (1 + exp(-ln(least(1 - 1e-6, greatest(1e-6, p)) / (1 - least(1 - 1e-6, greatest(1e-6, p)))) / temp)) AS q FROM li, t),
l AS (SELECT gidx, i, temp, avg(-(y * ln(least(1 - 1e-6, greatest(1e-6, q))) + (1 - y) * ln(1 - least(1 - 1e-6, greatest(1e-6, q))))) AS ll FROM x GROUP BY ALL)
SELECT gidx, round(arg_min(temp, ll), 9) AS temperature, round(min(ll), 9) AS logloss FROM l GROUP BY gidx""",
)
def temperature_scale(spark, sf):
    return rounded(M.temperature_fit(scored_rows(spark, sf), ["gidx"]), {"temperature": 9, "logloss": 9})


TAUS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9]


@query(
    "quantile_crossing",
    f"""WITH t AS (SELECT unnest({TAUS})::DOUBLE AS tau, unnest(range(0, 6)) AS i), b AS (SELECT l_partkey AS gidx, avg(l_quantity) AS a, min(l_discount) AS m FROM lineitem GROUP BY 1),
q AS (SELECT gidx, tau, (a - 26) / 4 + (tau - 0.5) * 3 - CASE WHEN i = 2 THEN 0.8 ELSE 0 END AS q FROM b, t),
e AS (SELECT *, max(q) OVER (PARTITION BY gidx ORDER BY tau) AS e FROM q),
l AS (SELECT *, lag(e) OVER (PARTITION BY gidx ORDER BY tau) AS e0, lag(tau) OVER (PARTITION BY gidx ORDER BY tau) AS t0 FROM e),
f AS (SELECT * FROM l WHERE e >= 0 QUALIFY row_number() OVER (PARTITION BY gidx ORDER BY tau) = 1)
SELECT b.gidx, round(CASE WHEN f.gidx IS NULL THEN 1 WHEN t0 IS NULL THEN tau
  ELSE t0 + CASE WHEN e - e0 > 1e-12 THEN least(1, greatest(0, -e0 / (e - e0))) ELSE 1 END * (tau - t0) END, 9) AS p_unsafe FROM b LEFT JOIN f USING (gidx)""",
)
def quantile_crossing(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gidx")).agg(F.avg("l_quantity").alias("a"))
    rows = li.select("gidx", "a", F.posexplode(F.array(*[F.lit(t) for t in TAUS])).alias("i", "tau"))
    q = (F.col("a") - 26) / 4 + (F.col("tau") - 0.5) * 3 - F.when(F.col("i") == 2, 0.8).otherwise(0.0)
    return rounded(M.quantile_crossing(rows.select("gidx", "tau", q.alias("q"))), {"p_unsafe": 9})


# Normal CDF in SQL: odd power series; t CDF with five degrees of freedom in closed form.
PHI = """0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 80), lambda i:
  sign(z) * exp((2 * i + 1) * ln(greatest(abs(z), 1e-12)) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))))"""
T5 = """0.5 + (atan(z / sqrt(5)) + z / sqrt(5) / (1 + z * z / 5) * (1 + 2 / (3 * (1 + z * z / 5)))) / pi()"""


@query(
    "gaussian_violation",
    f"""WITH {MARGIN_SQL}, x AS (SELECT gidx, -(margin - 1.9) / sqrt(0.8 * 1.1 + 1e-12) AS z FROM m)
SELECT gidx, count(*) AS n, round(sum({PHI}), 6) AS p_sum FROM x GROUP BY gidx""",
)
def gaussian_violation(spark, sf):
    p = V.gaussian_violation(F.col("margin") - 2.0, F.lit(0.8), bias=0.1, scale=1.1)
    rows = margins(spark, sf).withColumn("p", p)
    return rows.groupBy("gidx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("p_sum"))


@query(
    "student_t_violation",
    f"""WITH {MARGIN_SQL}, x AS (SELECT gidx, -(margin - 1.9) / sqrt(0.8 * 1.1 * 0.6 + 1e-12) AS z FROM m)
SELECT gidx, count(*) AS n, round(sum({T5}), 6) AS p_sum FROM x GROUP BY gidx""",
)
def student_t_violation(spark, sf):
    p = V.student_t_violation(F.col("margin") - 2.0, F.lit(0.8), df=5.0, bias=0.1, scale=1.1)
    rows = margins(spark, sf).withColumn("p", p)
    return rows.groupBy("gidx").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("p_sum"))


# scores of parts for the selection operators
SCORE_SQL = """so AS (SELECT l_partkey AS gidx, avg(l_quantity) / 50 AS score FROM lineitem GROUP BY 1),
done AS (SELECT p_partkey AS gidx FROM part WHERE p_size <= 10)"""


def part_scores(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gidx")).agg(
        (F.avg("l_quantity") / 50).alias("score")
    )


def labelled(spark, sf):
    return table(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("gidx"))


@query("provisional_threshold", f"WITH {SCORE_SQL} SELECT round(quantile_cont(least(1, greatest(0, score)), 0.8), 9) AS t FROM so")
def provisional_threshold(spark, sf):
    return rounded(S.provisional_threshold(part_scores(spark, sf), 0.8), {"t": 9})


@query("adaptive_level", f"WITH {SCORE_SQL} SELECT round(least(0.99, greatest(0.01, 1 - avg((score >= 0.52)::INT))), 9) AS q FROM so")
def adaptive_level(spark, sf):
    return rounded(S.adaptive_level(part_scores(spark, sf), 0.52), {"q": 9})


@query(
    "boundary_shortlist",
    f"""WITH {SCORE_SQL}, u AS (SELECT *, abs(score - 0.52) AS m FROM so WHERE gidx NOT IN (SELECT gidx FROM done))
SELECT gidx, round(score, 9) AS score, round(m, 9) AS margin FROM u
WHERE m <= 0.003 OR (SELECT count(*) FILTER (WHERE m <= 0.003) FROM u) < 10 ORDER BY m, gidx LIMIT 200""",
)
def boundary_shortlist(spark, sf):
    out = S.boundary_shortlist(part_scores(spark, sf), labelled(spark, sf), 0.52, 10, 20, band=0.003)
    return rounded(out, {"score": 9, "margin": 9})


@query(
    "farthest_first",
    f"""WITH RECURSIVE p AS (SELECT vec_id AS gidx, embedding::DOUBLE[] AS v FROM embeddings),
t AS (SELECT 0 AS rank, gidx, [gidx] AS picks, [v] AS held FROM (SELECT * FROM p ORDER BY {HASH.format("'5:' || gidx")}, gidx LIMIT 1)
  UNION ALL SELECT rank + 1, best.gidx, list_append(picks, best.gidx), list_append(held, best.v) FROM (
    SELECT rank, picks, held, arg_max(struct_pack(gidx := p.gidx, v := v), (list_min(list_transform(held, lambda w: list_distance(v, w))), -p.gidx)) AS best
    FROM t, p WHERE NOT list_contains(picks, p.gidx) AND rank < 11 GROUP BY rank, picks, held))
SELECT gidx, rank::INT AS rank FROM t""",
)
def farthest_first(spark, sf):
    pts = table(spark, sf, "embeddings").select(F.col("vec_id").alias("gidx"), F.col("embedding").alias("vec"))
    return S.farthest_first(pts, 12, seed=5)


@query(
    "argmin_ties",
    f"""WITH s AS (SELECT l_partkey AS gidx, min(l_quantity) + max(l_discount) AS v FROM lineitem GROUP BY 1),
n AS (SELECT * FROM s WHERE abs(v - (SELECT min(v) FROM s)) <= 1e-12 + 1e-12 * abs((SELECT min(v) FROM s)))
SELECT gidx, v, (SELECT count(*) FROM n) AS ties, (SELECT count(*) FROM n) = (SELECT count(*) FROM s) AS degenerate
FROM n ORDER BY {HASH.format("'5:' || gidx")}, gidx LIMIT 1""",
)
def argmin_ties(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("gidx")).agg(
        (F.min("l_quantity") + F.max("l_discount")).alias("v")
    )
    return S.argmin_ties(s, "v", 5)


@query(
    "best_config",
    """WITH r AS (SELECT l_suppkey AS family, l_linenumber AS ord, 'cfg' || l_linenumber AS cfg, round(avg(l_quantity), 1) AS loss FROM lineitem GROUP BY ALL)
SELECT family, cfg, loss FROM r QUALIFY row_number() OVER (PARTITION BY family ORDER BY loss, ord) = 1""",
)
def best_config(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("family"), F.col("l_linenumber").alias("ord")).agg(
        F.round(F.avg("l_quantity"), 1).alias("loss")
    )
    return S.best_config(rows.withColumn("cfg", F.concat(F.lit("cfg"), F.col("ord").cast("string"))), ["family"])


@query("unobserved_candidates", f"WITH {SCORE_SQL} SELECT gidx, round(score, 9) AS score FROM so WHERE gidx NOT IN (SELECT gidx FROM done)")
def unobserved_candidates(spark, sf):
    return rounded(S.unobserved(part_scores(spark, sf), labelled(spark, sf)), {"score": 9})


@query(
    "mask_jaccard",
    """WITH a AS (SELECT DISTINCT l_partkey AS g FROM lineitem WHERE l_quantity >= 48), b AS (SELECT DISTINCT l_partkey AS g FROM lineitem WHERE l_quantity <= 3)
SELECT round(1 - (SELECT count(*) FROM a JOIN b USING (g)) / (SELECT count(*) FROM (SELECT g FROM a UNION SELECT g FROM b)), 9) AS distance""",
)
def mask_jaccard(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gidx"), "l_quantity")
    return rounded(S.mask_jaccard(li.where("l_quantity >= 48"), li.where("l_quantity <= 3")), {"distance": 9})


@query(
    "al_boundary_stats",
    """SELECT l_linenumber AS cycle, round(avg((l_quantity / 50 >= 0.6)::INT), 9) AS v_pred, round(avg((abs(l_quantity / 50 - 0.6) <= 0.07)::INT), 9) AS boundary_mass
FROM lineitem GROUP BY 1""",
)
def al_boundary_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("cycle"), (F.col("l_quantity") / 50).alias("score"))
    return rounded(S.al_boundary_stats(rows, ["cycle"], 0.6, 0.07), {"v_pred": 9, "boundary_mass": 9})


@query(
    "label_effort",
    """SELECT l_linenumber AS cycle, l_returnflag AS mode, count(*) FILTER (WHERE l_tax > 0) AS decided, sum(l_suppkey)::BIGINT AS sims,
  round(sum(l_suppkey) / count(*) FILTER (WHERE l_tax > 0), 9) AS sims_per_decision FROM lineitem GROUP BY ALL""",
)
def label_effort(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("cycle"), F.col("l_returnflag").alias("mode"), F.col("l_suppkey").alias("n"),
        F.when(F.col("l_tax") > 0, 1).alias("label"),
    )
    return rounded(S.label_effort(rows, ["cycle", "mode"]), {"sims_per_decision": 9})


@query(
    "early_stop_streak",
    """WITH c AS (SELECT l_suppkey AS run, l_orderkey AS cycle, min(l_discount) AS distance FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER w AS i, sum((distance > 0.06)::INT) OVER w AS grp FROM c WINDOW w AS (PARTITION BY run ORDER BY cycle)),
s AS (SELECT *, i - coalesce(max(CASE WHEN distance > 0.06 THEN i END) OVER (PARTITION BY run ORDER BY cycle), 0) AS streak FROM n)
SELECT run, cycle, distance, streak, streak >= 5 AS stop FROM s""",
)
def early_stop_streak(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("run"), F.col("l_orderkey").alias("cycle")).agg(
        F.min("l_discount").alias("distance")
    )
    return S.early_stop_streak(c, ["run"], 0.06, 5)


