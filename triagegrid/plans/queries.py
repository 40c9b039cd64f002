"""The operators over the driver's tables, each with the SQL that says the same.

Stand-ins: lineitem rows are findings, their discount the severity, returned
rows the label; parts are components; regions, nations, suppliers and parts the
dependency graph; orders carry dates and tiers; documents and pages the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.functions import cvss, text, versions
from triagegrid.functions.numbers import half_even, half_up, risk_tier, sigmoid, soft_ceiling
from triagegrid.operators import correlate as C
from triagegrid.operators import graph, live, nested, ranking, rates, rows, scoring
from triagegrid.session import persisted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _r(name: str, digits: int = 6):
    """Rounding that both engines do alike."""
    return half_up(F.col(name), digits).alias(name)


def R(expr: str, digits: int = 6) -> str:  # noqa: N802
    f = f"CAST(1e{digits} AS DOUBLE)"
    return f"CAST(floor(({expr}) * {f} + 0.5) AS DOUBLE) / {f}"


# ---- ranking metrics ---------------------------------------------------------------------------------------------

FINDINGS = "SELECT l_discount * 100 AS score, CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END AS y FROM lineitem"
BLOCKS = f"""b AS (SELECT score, count(*) AS g, sum(y) AS h FROM ({FINDINGS}) GROUP BY score),
    k AS (SELECT score, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h, CAST(coalesce(sum(g) OVER w, 0) AS DOUBLE) AS before, CAST(coalesce(sum(h) OVER w, 0) AS DOUBLE) AS hb
        FROM b WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT sum(g) AS n, sum(h) AS p FROM k)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_discount") * 100).alias("score"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).cast("int").alias("y"))


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.tied_blocks(findings(spark, sf), "score", "y")


@query(f"WITH {BLOCKS} SELECT score, CAST(g AS BIGINT) AS g, CAST(h AS BIGINT) AS h, CAST(before AS BIGINT) AS before, CAST(hb AS BIGINT) AS hits_before FROM k")
def tie_blocks(spark, sf):
    return blocks(spark, sf)


@query(f"WITH {BLOCKS} SELECT score, CAST(g AS BIGINT) AS g, CAST(h AS BIGINT) AS h, CAST(before AS BIGINT) AS before, CAST(hb AS BIGINT) AS hits_before FROM k")
def tie_blocks_two_phase(spark, sf):
    return ranking.tied_blocks(findings(spark, sf), "score", "y", parts=4)


def _hits(k: int) -> str:
    return f"sum(CASE WHEN before + g <= {k} THEN h WHEN before < {k} THEN ({k} - before) * h / g ELSE 0 END)"


@query(f"WITH {BLOCKS} SELECT {R(_hits(10000))} AS hits_10000, {R(_hits(10000) + ' / 10000')} AS precision_10000, {R(_hits(500) + ' / 500')} AS precision_500 FROM k")
def precision_at_k(spark, sf):
    b = blocks(spark, sf).agg(ranking.expected_hits(10000).alias("hits_10000"), ranking.precision_at(10000).alias("precision_10000"), ranking.precision_at(500).alias("precision_500"))
    return b.select(_r("hits_10000"), _r("precision_10000"), _r("precision_500"))


@query(f"WITH {BLOCKS} SELECT {R(_hits(1000) + ' / sum(h)')} AS recall_1000, {R(_hits(20000) + ' / sum(h)')} AS recall_20000 FROM k")
def recall_at_k(spark, sf):
    return blocks(spark, sf).agg(ranking.recall_at(1000).alias("recall_1000"), ranking.recall_at(20000).alias("recall_20000")).select(_r("recall_1000"), _r("recall_20000"))


def _effort(f: float) -> str:
    need = f"ceil(CAST({f} AS DOUBLE) * p - 1e-12)"
    return f"min(CASE WHEN hb < {need} AND hb + h >= {need} THEN (before + ({need} - hb) * (g + 1) / (h + 1)) / n END)"


@query(f"WITH {BLOCKS} SELECT {R(_effort(0.5))} AS effort_50, {R(_effort(0.75))} AS effort_75, {R(_effort(0.9))} AS effort_90 FROM k, t")
def effort_to_cover(spark, sf):
    return ranking.report(blocks(spark, sf), at=(), recall=(), efforts=(0.5, 0.75, 0.9)).select(_r("effort_50"), _r("effort_75"), _r("effort_90"))


@query(f"WITH {BLOCKS} SELECT {R('sum(h * (before + (g + 1) / 2)) / sum(h)', 3)} AS mean_rank FROM k")
def mean_rank_positives(spark, sf):
    return blocks(spark, sf).agg(ranking.mean_rank().alias("mean_rank")).select(_r("mean_rank", 3))


AUC = "sum((g - h) * (hb + h / 2)) / (sum(h) * (sum(g) - sum(h)))"
AP = "sum(h * (hb + h) / (before + g)) / sum(h)"


@query(f"WITH {BLOCKS} SELECT {R(AUC)} AS roc_auc FROM k")
def roc_auc(spark, sf):
    return blocks(spark, sf).agg(ranking.roc_auc().alias("roc_auc")).select(_r("roc_auc"))


@query(f"WITH {BLOCKS} SELECT {R(AP)} AS avg_precision FROM k")
def avg_precision(spark, sf):
    return blocks(spark, sf).agg(ranking.average_precision().alias("avg_precision")).select(_r("avg_precision"))


@query(f"""WITH {BLOCKS}, grid AS (SELECT CAST(i AS BIGINT) AS point, i / CAST(199 AS DOUBLE) AS worked FROM range(200) r(i)),
    e AS (SELECT before / n AS x0, (before + g) / n AS x1, hb / p AS y0, (hb + h) / p AS y1 FROM k, t)
    SELECT point, {R('worked')} AS worked, {R('y0 + (y1 - y0) * (worked - x0) / (x1 - x0)')} AS covered FROM grid JOIN e ON (worked > x0 OR (point = 0 AND x0 = 0)) AND worked <= x1""")
def coverage_curve(spark, sf):
    return ranking.coverage_curve(blocks(spark, sf)).select("point", _r("worked"), _r("covered"))


LONG = """SELECT 'discount' AS ranker, l_discount AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus FROM lineitem
    UNION ALL SELECT 'tax', l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_linestatus FROM lineitem
    UNION ALL SELECT 'price', CAST(floor(l_extendedprice / 1000) AS DOUBLE), CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_linestatus FROM lineitem"""


def _rankers(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")).withColumn("price", F.floor(F.col("l_extendedprice") / 1000).cast("double"))
    return li.select("y", "l_linestatus", F.explode(F.array(*[F.struct(F.lit(n).alias("ranker"), F.col(c).alias("score")) for n, c in (("discount", "l_discount"), ("tax", "l_tax"), ("price", "price"))])).alias("r")).select("r.*", "y", "l_linestatus")


def _report_sql(where: str) -> str:
    return f"""WITH b AS (SELECT ranker, score, count(*) AS g, sum(y) AS h FROM ({LONG}) {where} GROUP BY ranker, score),
    k AS (SELECT ranker, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h, CAST(coalesce(sum(g) OVER w, 0) AS DOUBLE) AS before, CAST(coalesce(sum(h) OVER w, 0) AS DOUBLE) AS hb
        FROM b WINDOW w AS (PARTITION BY ranker ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT ranker, sum(g) AS n, sum(h) AS p FROM k GROUP BY ranker)
    SELECT k.ranker, CAST(sum(g) AS BIGINT) AS n, CAST(sum(h) AS BIGINT) AS positives, {R(AUC)} AS roc_auc, {R(AP)} AS avg_precision, {R('sum(h * (before + (g + 1) / 2)) / sum(h)', 3)} AS mean_rank,
        {R(_effort(0.9))} AS effort_90, {R(_hits(100) + ' / least(100, sum(g))')} AS precision_100, {R(_hits(500) + ' / least(500, sum(g))')} AS precision_500, {R(_hits(1000) + ' / sum(h)')} AS recall_1000
    FROM k JOIN t ON k.ranker = t.ranker GROUP BY k.ranker"""


def _report(df: DataFrame) -> DataFrame:
    out = ranking.report(ranking.tied_blocks(df, "score", "y", by=["ranker"]), by=["ranker"])
    return out.select("ranker", "n", "positives", _r("roc_auc"), _r("avg_precision"), _r("mean_rank", 3), _r("effort_90"), _r("precision_100"), _r("precision_500"), _r("recall_1000"))


@query(_report_sql(""))
def rank_metrics_by_ranker(spark, sf):
    return _report(_rankers(spark, sf))


@query(_report_sql("WHERE l_linestatus = 'O'"))
def open_only_metrics(spark, sf):
    return _report(_rankers(spark, sf).where("l_linestatus = 'O'"))


@query("""WITH m AS (SELECT min(l_tax) + 0.0::DOUBLE AS value, count(*) AS total FROM lineitem)
    SELECT value, count(*) AS n, CAST(count(*) AS DOUBLE) / CAST(any_value(total) AS DOUBLE) AS share, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS positives
    FROM lineitem, m WHERE l_tax <= value + 1e-12 GROUP BY value""")
def floor_block(spark, sf):
    li = table(spark, sf, "lineitem").select("l_tax", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return ranking.floor_block(li.withColumn("l_tax", F.col("l_tax") + F.lit(0.0)), "l_tax", "y")


# ---- CVSS and numbers ----------------------------------------------------------------------------------------------

VECTOR = """'CVSS:3.1/AV:' || substr('NALP', 1 + p_partkey % 4, 1) || '/AC:' || substr('LH', 1 + p_partkey % 2, 1) || '/PR:' || substr('NLH', 1 + p_partkey % 3, 1)
    || '/UI:' || substr('NR', 1 + p_size % 2, 1) || '/S:' || substr('UCX', 1 + p_size % 3, 1) || '/C:' || substr('HLN', 1 + p_partkey % 3, 1)
    || '/I:' || substr('HLN', 1 + p_size % 3, 1) || '/A:' || substr('HLN', 1 + (p_partkey + p_size) % 3, 1)"""
VECTOR_SQL = f"""v AS (SELECT *, {VECTOR} AS vector FROM part), m AS (SELECT *, CASE WHEN vector NOT LIKE '%/S:X%' THEN 1 END AS ok, substr(vector, 13, 1) AS av, regexp_extract(vector, '/AC:(.)', 1) AS ac,
    regexp_extract(vector, '/PR:(.)', 1) AS pr, regexp_extract(vector, '/UI:(.)', 1) AS ui, regexp_extract(vector, '/S:(.)', 1) AS s, regexp_extract(vector, '/C:(.)', 1) AS c,
    regexp_extract(vector, '/I:(.)', 1) AS i, regexp_extract(vector, '/A:(.)', 1) AS a FROM v)"""


def _cia(m: str) -> str:
    return f"(1 - CASE {m} WHEN 'H' THEN CAST(0.56 AS DOUBLE) WHEN 'L' THEN CAST(0.22 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"


ISS = f"(1 - {_cia('c')} * {_cia('i')} * {_cia('a')})"
IMPACT = f"""CASE WHEN ok = 1 THEN CAST(floor((greatest(CAST(0 AS DOUBLE), CASE WHEN s = 'U' THEN CAST(6.42 AS DOUBLE) * {ISS} ELSE CAST(7.52 AS DOUBLE) * ({ISS} - CAST(0.029 AS DOUBLE)) - CAST(3.25 AS DOUBLE) * pow({ISS} - CAST(0.02 AS DOUBLE), 15) END) + CAST(1e-9 AS DOUBLE)) * 10 + 0.5) AS DOUBLE) / 10 END"""


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "part").withColumn("vector", F.expr(VECTOR)).withColumn("m", cvss.parsed(F.col("vector")))


@query(f"WITH {VECTOR_SQL} SELECT p_partkey, " + ", ".join(f"CASE WHEN ok = 1 THEN {x} END AS {x}" for x in ("av", "ac", "pr", "ui", "s", "c", "i", "a")) + " FROM m")
def cvss_vector_parse(spark, sf):
    return _vectors(spark, sf).select("p_partkey", "m.*")


@query(f"WITH {VECTOR_SQL} SELECT p_partkey, {IMPACT} AS impact, coalesce(ok = 1 AND s = 'C', false) AS scope_changed, CAST(floor(least(CAST(6 AS DOUBLE), CAST(floor((p_size / 5.0::DOUBLE) * CAST(0.6 AS DOUBLE) * 100 + 0.5) AS DOUBLE) / 100) * 100 + 0.5) AS DOUBLE) / 100 AS estimate FROM m")
def cvss_impact(spark, sf):
    return _vectors(spark, sf).select("p_partkey", cvss.impact(F.col("m")).alias("impact"), cvss.scope_changed(F.col("m")).alias("scope_changed"), half_up(cvss.impact_from_base(F.col("p_size") / F.lit(5.0)), 2).alias("estimate"))


@query(f"WITH {VECTOR_SQL} SELECT p_partkey, CASE WHEN ok = 1 THEN 0 ELSE 1 END AS cvss_missing, " + ", ".join(f"CASE WHEN ok = 1 AND {m.lower()} = '{v}' THEN 1 ELSE 0 END AS {m.lower()}_{v}" for m, vs in K.CVSS_METRICS.items() for v in vs) + " FROM m")
def cvss_onehot(spark, sf):
    return _vectors(spark, sf).select("p_partkey", F.col("m").isNull().cast("int").alias("cvss_missing"), *cvss.one_hot(F.col("m")))


CEIL = "CASE WHEN {x} <= 90 THEN {x} ELSE 100 - 10 * exp(-({x} - 90) / 10) END"
TIER = "CASE WHEN {x} >= 75 THEN 'Critical' WHEN {x} >= 50 THEN 'High' WHEN {x} >= 25 THEN 'Medium' ELSE 'Low' END"


@query(f"SELECT o_orderkey, {R(CEIL.format(x='o_totalprice / 2000'))} AS risk, {TIER.format(x='(' + CEIL.format(x='o_totalprice / 2000') + ')')} AS tier FROM orders")
def soft_ceiling_tier(spark, sf):
    risk = soft_ceiling(F.col("o_totalprice") / 2000)
    return table(spark, sf, "orders").select("o_orderkey", half_up(risk, 6).alias("risk"), risk_tier(risk).alias("tier"))


@query(f"SELECT l_orderkey, l_linenumber, {R('l_extendedprice * l_discount', 2)} AS two, {R('l_tax * l_discount', 3)} AS three FROM lineitem")
def half_up_round(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", half_up(F.col("l_extendedprice") * F.col("l_discount"), 2).alias("two"), half_up(F.col("l_tax") * F.col("l_discount"), 3).alias("three"))


@query(f"SELECT l_orderkey, l_linenumber, {R('1 / (1 + exp(-greatest(least((l_quantity - 25) * 2, 35), -35)))', 9)} AS p FROM lineitem")
def sigmoid_clip(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", half_up(sigmoid((F.col("l_quantity") - 25) * 2), 9).alias("p"))


# ---- scoring ---------------------------------------------------------------------------------------------------

SCORED_SQL = """f AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS cvss_base, l_quantity / 50 * 6 AS cvss_impact, l_linestatus = 'O' AS scope_changed, l_tax * 12.5::DOUBLE AS epss,
    CASE WHEN l_suppkey % 10 < 8 THEN l_discount * 10 END AS p_model, l_returnflag = 'R' AS kev, l_suppkey % 3 = 0 AS poc_github, l_suppkey % 5 = 0 AS poc_exploitdb,
    CASE WHEN l_suppkey % 7 = 0 THEN 'poc' END AS maturity_override, l_linenumber AS fanin, l_suppkey % 4 AS kind, l_partkey % 3 AS tier0 FROM lineitem)"""


def _scored(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    tier = (F.col("l_partkey") % 3).cast("int") + 1
    crit = F.when(tier == 1, "Critical").when(tier == 2, "High").otherwise("Medium")
    one = lambda k: F.struct(F.concat(F.lit("s"), F.lit(k)).alias("name"), tier.alias("tier"), crit.alias("criticality"), (F.lit(k) == 1).alias("internet_facing"), F.lit(False).alias("handles_pii"), F.array().cast("array<string>").alias("components"), F.array().cast("array<string>").alias("hosts"))
    kind = F.col("l_suppkey") % 4
    none = F.array().cast(scoring._SERVICES)
    services = F.when(kind <= 1, none).when(kind == 2, F.array(one(1))).otherwise(F.array(one(1), one(2), one(3)).cast(scoring._SERVICES))
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("cvss_base"), (F.col("l_quantity") / 50 * 6).alias("cvss_impact"), (F.col("l_linestatus") == "O").alias("scope_changed"),
        (F.col("l_tax") * 12.5).alias("epss"), F.when(F.col("l_suppkey") % 10 < 8, F.col("l_discount") * 10).alias("p_model"), (F.col("l_returnflag") == "R").alias("kev"),
        (F.col("l_suppkey") % 3 == 0).alias("poc_github"), (F.col("l_suppkey") % 5 == 0).alias("poc_exploitdb"), F.when(F.col("l_suppkey") % 7 == 0, "poc").alias("maturity_override"),
        F.col("l_linenumber").alias("fanin"), F.lit(7).alias("max_fanin"), (kind > 0).alias("has_context"), services.alias("services"),
    )


MULT = "CASE tier0 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END"
CRIT = f"CASE WHEN kind = 0 THEN 1.0::DOUBLE WHEN kind = 1 THEN 1.25::DOUBLE ELSE {MULT} * 1.2::DOUBLE END"


def _ml_sql(drop: str = "") -> str:
    p = "0" if drop == "model" else "coalesce(p_model, 0)"
    e = "0" if drop == "epss" else "epss"
    k = "0" if drop == "kev" else "CASE WHEN kev THEN 1 ELSE 0 END"
    fan = "0" if drop == "fanin" else "fanin / 7.0::DOUBLE"
    crit = "1.0::DOUBLE" if drop == "asset" else f"({CRIT})"
    scope = "1.0::DOUBLE" if drop == "scope" else "CASE WHEN scope_changed THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END"
    return f"100.0::DOUBLE * ({p} * 0.5::DOUBLE + {e} * 0.3::DOUBLE + {k} * 0.2::DOUBLE) * ((least(1.0::DOUBLE, cvss_impact / 6) * 0.5::DOUBLE + {fan} * 0.5::DOUBLE) * {crit}) * {scope}"


@query(f"WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, {R(_ml_sql(), 4)} AS raw, {R(CEIL.format(x='(' + _ml_sql() + ')'), 4)} AS risk FROM f")
def score_ml(spark, sf):
    return _scored(spark, sf).withColumn("s", scoring.combined()).select("l_orderkey", "l_linenumber", half_up(F.col("s.raw"), 4).alias("raw"), half_up(F.col("s.risk"), 4).alias("risk"))


@query(f"WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, " + ", ".join(f"{R(_ml_sql(d), 4)} AS no_{d}" for d in K.ABLATIONS) + " FROM f")
def score_ml_ablation(spark, sf):
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", *[half_up(scoring.combined((d,))["raw"], 4).alias(f"no_{d}") for d in K.ABLATIONS])


LABEL = "CASE WHEN kev THEN 'kev' WHEN maturity_override IS NOT NULL THEN maturity_override WHEN poc_exploitdb THEN 'weaponized' WHEN poc_github THEN 'poc' ELSE 'none' END"
WEIGHT = "CASE tier0 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7::DOUBLE ELSE 0.4::DOUBLE END"
LEGACY_SQL = f"""{SCORED_SQL}, g AS (SELECT *, {LABEL} AS label, CASE WHEN kind <= 1 THEN 0 WHEN kind = 2 THEN {WEIGHT} ELSE {WEIGHT} + {WEIGHT} + {WEIGHT} END AS weight, least(1.0::DOUBLE, fanin / 5.0::DOUBLE) AS graph FROM f),
    h AS (SELECT *, {R('CASE WHEN kind >= 2 THEN least(1.0::DOUBLE, weight / 3) * 0.75::DOUBLE + graph * 0.25::DOUBLE ELSE graph END', 3)} AS blast,
        {R("epss * 0.65::DOUBLE + CASE label WHEN 'kev' THEN 1.0::DOUBLE WHEN 'weaponized' THEN 0.9::DOUBLE WHEN 'poc' THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END * 0.35::DOUBLE", 4)} AS likelihood FROM g),
    i AS (SELECT *, {R('least(1.0::DOUBLE, cvss_impact / 6) * 0.5::DOUBLE + blast * 0.5::DOUBLE', 4)} AS impact FROM h),
    j AS (SELECT *, likelihood * impact * 100 * CASE WHEN scope_changed THEN 1.15::DOUBLE WHEN kind = 3 OR fanin >= 3 THEN 1.08::DOUBLE ELSE 1.0::DOUBLE END AS raw FROM i)"""


@query(f"WITH {LEGACY_SQL} SELECT l_orderkey, l_linenumber, label AS maturity_label, likelihood, impact, blast AS blast_radius, {R(R(CEIL.format(x='raw'), 2), 2)} AS risk FROM j")
def score_legacy(spark, sf):
    s = _scored(spark, sf).withColumn("s", scoring.legacy())
    return s.select("l_orderkey", "l_linenumber", "s.maturity_label", "s.likelihood", "s.impact", "s.blast_radius", half_up(F.col("s.risk"), 2).alias("risk"))


@query(f"WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, {LABEL} AS label FROM f")
def maturity_label(spark, sf):
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", scoring.maturity_label().alias("label"))


@query(f"WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, {R(CRIT)} AS crit FROM f")
def crit_multiplier(spark, sf):
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", half_up(scoring.criticality_multiplier(F.col("services"), F.col("has_context")), 6).alias("crit"))


def _rank_query(mode: str, raw: str, extra: str = "f") -> str:
    return f"""WITH {LEGACY_SQL}, r AS (SELECT l_orderkey, l_linenumber, l_orderkey % 50 AS app, {R(raw, 4)} AS raw, cvss_base FROM j)
        SELECT app, l_orderkey, l_linenumber, raw, row_number() OVER (PARTITION BY app ORDER BY raw DESC, cvss_base DESC, l_orderkey, l_linenumber) AS rank FROM r"""


def _ranked(spark, sf, score) -> DataFrame:
    s = _scored(spark, sf).select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 50).alias("app"), half_up(score, 4).alias("raw"), "cvss_base")
    return scoring.rank(s, "raw", "cvss_base", ["l_orderkey", "l_linenumber"], by=["app"]).drop("cvss_base")


@query(_rank_query("cvss", R("cvss_base * 10", 2)))
def rank_cvss(spark, sf):
    return _ranked(spark, sf, scoring.severity(F.col("cvss_base"))["raw"])


@query(_rank_query("legacy", "raw"))
def rank_legacy(spark, sf):
    return _ranked(spark, sf, scoring.legacy()["raw"])


@query(_rank_query("ml", _ml_sql()))
def rank_ml(spark, sf):
    return _ranked(spark, sf, scoring.combined()["raw"])


def _effort_sql(drop: str) -> str:
    return f"""SELECT '{drop or "full"}' AS variant, {R(_ml_sql(drop), 4)} AS score, CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS y FROM f"""


@query(f"""WITH {SCORED_SQL}, long AS ({' UNION ALL '.join(_effort_sql(d) for d in ('', *K.ABLATIONS))}), b AS (SELECT variant, score, count(*) AS g, sum(y) AS h FROM long GROUP BY variant, score),
    k AS (SELECT variant, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h, CAST(coalesce(sum(g) OVER w, 0) AS DOUBLE) AS before, CAST(coalesce(sum(h) OVER w, 0) AS DOUBLE) AS hb
        FROM b WINDOW w AS (PARTITION BY variant ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT variant, sum(g) AS n, sum(h) AS p FROM k GROUP BY variant), e AS (SELECT k.variant, {_effort(0.9)} AS effort FROM k JOIN t ON k.variant = t.variant GROUP BY k.variant)
    SELECT e.variant, {R('e.effort')} AS effort_90, {R('e.effort - x.effort')} AS delta FROM e, e x WHERE x.variant = 'full'""")
def ablation_effort(spark, sf):
    s = _scored(spark, sf).withColumn("y", (F.col("l_linenumber") == 7).cast("int"))
    variants = F.array(*[F.struct(F.lit(d or "full").alias("variant"), half_up(scoring.combined((d,) if d else ())["raw"], 4).alias("score")) for d in ("", *K.ABLATIONS)])
    long = s.select("y", F.explode(variants).alias("v")).select("v.*", "y")
    out = ranking.report(ranking.tied_blocks(long, "score", "y", by=["variant"]), by=["variant"], at=(), recall=())
    full = out.where("variant = 'full'").select(F.col("effort_90").alias("__full"))
    return out.crossJoin(F.broadcast(full)).select("variant", half_up(F.col("effort_90"), 6).alias("effort_90"), half_up(F.col("effort_90") - F.col("__full"), 6).alias("delta"))


# ---- graph -----------------------------------------------------------------------------------------------------

EDGES_SQL = """e AS (SELECT DISTINCT 'R' || n_regionkey AS ref, 'N' || n_nationkey AS dep FROM nation UNION SELECT DISTINCT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
    UNION SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem WHERE l_quantity > 40 UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation WHERE n_nationkey % 5 = 0)"""
CLOSURE_SQL = f"WITH RECURSIVE {EDGES_SQL}, a AS (SELECT dep AS node, ref AS ancestor FROM e UNION SELECT a.node, e.ref FROM a JOIN e ON a.ancestor = e.dep)"


def _edges(spark, sf) -> DataFrame:
    n, s, li = (table(spark, sf, t) for t in ("nation", "supplier", "lineitem"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = n.select(name("R", "n_regionkey").alias("ref"), name("N", "n_nationkey").alias("dep"))
    out = out.union(s.select(name("N", "s_nationkey"), name("S", "s_suppkey"))).union(li.where("l_quantity > 40").select(name("S", "l_suppkey"), name("P", "l_partkey")))
    back = n.where("n_nationkey % 5 = 0").select(name("N", "n_nationkey"), name("R", "n_regionkey"))
    return graph.edges_of(out.union(back).groupBy("ref").agg(F.collect_list("dep").alias("dependsOn")))


@query(f"WITH {EDGES_SQL} SELECT ref, dep FROM e")
def edges(spark, sf):
    return _edges(spark, sf)


@query(f"{CLOSURE_SQL} SELECT node, ancestor FROM a")
def ancestors(spark, sf):
    return graph.ancestors(spark, _edges(spark, sf))


FANIN_SQL = f"{CLOSURE_SQL}, nodes AS (SELECT ref AS node FROM e UNION SELECT dep FROM e), f AS (SELECT n.node, count(a.ancestor) AS fanin FROM nodes n LEFT JOIN a ON a.node = n.node GROUP BY n.node)"


def _fanin(spark, sf) -> DataFrame:
    e = _edges(spark, sf)
    return graph.fan_in(e.select(F.col("ref").alias("node")).union(e.select("dep")), graph.ancestors(spark, e))


@query(f"{FANIN_SQL} SELECT node, fanin FROM f")
def fanin(spark, sf):
    return _fanin(spark, sf)


@query(f"{FANIN_SQL} SELECT max(fanin) AS max_fanin, count(*) AS nodes FROM f")
def max_fanin(spark, sf):
    return _fanin(spark, sf).agg(F.max("fanin").alias("max_fanin"), F.count(F.lit(1)).alias("nodes"))


# ---- correlation ---------------------------------------------------------------------------------------------------

COMP_SQL = """c AS (SELECT p_partkey AS ord, 'ref-' || (p_partkey - p_partkey % 3) AS bom_ref, split_part(p_name, ' ', 1) AS name, p_brand AS grp, CAST(p_size AS VARCHAR) AS version, 'pkg:x/' || p_brand || '/' || (p_partkey % 97) || '@' || p_size AS purl FROM part),
    q AS (SELECT l_orderkey * 10 + l_linenumber AS finding_ord, CASE WHEN l_linenumber = 1 THEN 'ref-' || (l_partkey - l_partkey % 4) ELSE '' END AS bom_ref,
        CASE WHEN l_linenumber = 2 THEN 'PKG:x/' || p_brand || '/' || (l_partkey % 97) || '@' || (p_size + l_orderkey % 2) || '?a=1#s' ELSE '' END AS purl,
        CASE WHEN l_linenumber = 3 THEN upper(p_brand) || ':' || split_part(p_name, ' ', 1) WHEN l_linenumber = 4 THEN 'lib' || split_part(p_name, ' ', 1) ELSE 'none-' || l_partkey END AS pkg_name,
        CAST(p_size AS VARCHAR) AS pkg_version, 'CVE-' || (2000 + l_partkey % 20) || '-' || (1000 + l_suppkey) AS cve_id FROM lineitem JOIN part ON p_partkey = l_partkey),
    c1 AS (SELECT bom_ref, max(ord) AS ord FROM c GROUP BY 1), c2 AS (SELECT lower(regexp_replace(purl, '[?#].*', '')) AS purl, max(ord) AS ord FROM c GROUP BY 1),
    c3 AS (SELECT k, min(ord) AS ord FROM (SELECT lower(name) || '@' || version AS k, ord FROM c UNION ALL SELECT lower(grp) || ':' || lower(name) || '@' || version, ord FROM c UNION ALL SELECT lower(grp) || '/' || lower(name) || '@' || version, ord FROM c) GROUP BY 1),
    m0 AS (SELECT q.*, c1.ord AS o1, c2.ord AS o2, c3.ord AS o3 FROM q LEFT JOIN c1 ON q.bom_ref <> '' AND q.bom_ref = c1.bom_ref LEFT JOIN c2 ON q.purl <> '' AND lower(regexp_replace(q.purl, '[?#].*', '')) = c2.purl
        LEFT JOIN c3 ON lower(q.pkg_name) || '@' || q.pkg_version = c3.k),
    m1 AS (SELECT *, coalesce(o1, o2, o3) AS o, CASE WHEN o1 IS NOT NULL THEN 'bom-ref' WHEN o2 IS NOT NULL THEN 'purl' WHEN o3 IS NOT NULL THEN 'name@version' END AS how FROM m0)"""
FUZZY_SQL = """, z AS (SELECT m1.finding_ord, min(c.ord) AS ord FROM m1 JOIN c ON m1.o IS NULL AND c.version = m1.pkg_version AND (contains(lower(m1.pkg_name), lower(c.name)) OR contains(lower(c.name), lower(m1.pkg_name))) GROUP BY 1)"""


def _components(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    purl = F.concat(F.lit("pkg:x/"), "p_brand", F.lit("/"), (k % 97).cast("string"), F.lit("@"), size)
    return p.select(k.alias("ord"), F.concat(F.lit("ref-"), (k - k % 3).cast("string")).alias("bom_ref"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.col("p_brand").alias("group"), size.alias("version"), purl.alias("purl"), F.lit(0).alias("dependency_depth"), F.lit("direct").alias("dependency_type"))


def _scan(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    name = F.when(n == 3, F.concat(F.upper("p_brand"), F.lit(":"), word)).when(n == 4, F.concat(F.lit("lib"), word)).otherwise(F.concat(F.lit("none-"), k.cast("string")))
    purl = F.when(n == 2, F.concat(F.lit("PKG:x/"), "p_brand", F.lit("/"), (k % 97).cast("string"), F.lit("@"), (F.col("p_size") + F.col("l_orderkey") % 2).cast("string"), F.lit("?a=1#s"))).otherwise("")
    cve = F.concat(F.lit("CVE-"), (2000 + k % 20).cast("string"), F.lit("-"), (1000 + F.col("l_suppkey")).cast("string"))
    ref = F.when(n == 1, F.concat(F.lit("ref-"), (k - k % 4).cast("string"))).otherwise("")
    return li.select((F.col("l_orderkey") * 10 + n).alias("finding_ord"), ref.alias("bom_ref"), purl.alias("purl"), name.alias("pkg_name"), F.col("p_size").cast("string").alias("pkg_version"), cve.alias("cve_id"))


@query(f"WITH {COMP_SQL}, r AS (SELECT m1.*, c.bom_ref AS ref, row_number() OVER (PARTITION BY c.bom_ref, cve_id ORDER BY finding_ord) AS n FROM m1 JOIN c ON c.ord = m1.o) SELECT finding_ord, ref AS component_ref, cve_id, how AS match, ref || '|' || cve_id AS finding_id FROM r WHERE n = 1")
def correlate_cascade(spark, sf):
    return C.matched(C.correlate(_scan(spark, sf), _components(spark, sf))).select("finding_ord", "component_ref", "cve_id", "match", "finding_id")


@query(f"WITH {COMP_SQL}{FUZZY_SQL} SELECT m1.finding_ord, coalesce(m1.how, CASE WHEN z.ord IS NOT NULL THEN 'fuzzy' END) AS match, coalesce(m1.o, z.ord) AS component_ord FROM m1 LEFT JOIN z ON z.finding_ord = m1.finding_ord")
def correlate_fuzzy(spark, sf):
    return C.correlate(_scan(spark, sf), _components(spark, sf), fuzzy=True).select("finding_ord", "match", F.col("component.ord").alias("component_ord"))


@query(f"WITH {COMP_SQL} SELECT finding_ord, cve_id, pkg_name FROM m1 WHERE o IS NULL")
def correlate_unmatched(spark, sf):
    return C.unmatched(C.correlate(_scan(spark, sf), _components(spark, sf))).select("finding_ord", "cve_id", "pkg_name")


# ---- rows: dedup, enrichment, rates, summaries ---------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedup_keep_last(spark, sf):
    return rows.keep_last(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_keep_first(spark, sf):
    return rows.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def left_enrich(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n.where("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("WITH p AS (SELECT median(s_acctbal) AS prior FROM supplier) SELECT l_orderkey, l_linenumber, coalesce(s_acctbal, prior) AS p_model, CASE WHEN s_acctbal IS NULL THEN 'prior' ELSE 'model' END AS p_source FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) ON l_suppkey = s_suppkey, p")
def prior_fallback(spark, sf):
    s = table(spark, sf, "supplier")
    prior = F.lit(rows.exact_median(s, "s_acctbal")).cast("double")
    joined = table(spark, sf, "lineitem").join(s.where("s_suppkey % 4 <> 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce(F.col("s_acctbal"), prior).alias("p_model"), F.when(F.col("s_acctbal").isNull(), "prior").otherwise("model").alias("p_source"))


@query("""WITH live AS (SELECT user_id, arg_max(value, event_id) AS epss FROM events WHERE event_id % 3 = 0 GROUP BY 1), snap AS (SELECT user_id, min(value) AS epss FROM events WHERE event_id % 4 > 0 GROUP BY 1), kev AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
    SELECT w.user_id, coalesce(l.epss, 0.0::DOUBLE) AS epss, s.epss AS before, k.user_id IS NOT NULL AS kev FROM (SELECT DISTINCT user_id FROM events) w LEFT JOIN snap s USING (user_id) LEFT JOIN live l USING (user_id) LEFT JOIN kev k USING (user_id)""")
def live_override(spark, sf):
    """Ids that the live scores leave out have 0, whatever the snapshot says."""
    e = table(spark, sf, "events")
    now = e.where("event_id % 3 = 0").select("user_id", "event_id", F.col("value").alias("epss"))
    snap = e.where("event_id % 4 > 0").groupBy("user_id").agg(F.min("value").alias("epss")).withColumn("before", F.col("epss")).withColumn("kev", F.lit(False))
    out = live.override(snap, now, e.where("event_type = 'purchase'"), key="user_id", order="event_id", wanted=e)
    return out.select("user_id", "epss", "before", "kev")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_targets(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("""WITH f AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), w AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
    SELECT coalesce(f.k, w.k) AS k, CASE WHEN f.k IS NOT NULL AND w.k IS NOT NULL THEN 'both' WHEN w.k IS NOT NULL THEN 'missing' ELSE 'extra' END AS side FROM f FULL JOIN w ON f.k = w.k""")
def set_diff_verify(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", F.col("l_partkey"))
    return rows.set_difference(li.where("l_returnflag = 'R'"), li.where("l_quantity > 45"), "k")


Y = "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE)"


def _labelled(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"))


@query(f"WITH p AS (SELECT avg({Y}) AS prior FROM lineitem) SELECT l_suppkey, {R(f'(sum({Y}) + 20 * any_value(prior)) / (count(*) + 20)', 9)} AS rate FROM lineitem, p GROUP BY l_suppkey")
def rate_table(spark, sf):
    return rates.rate_table(_labelled(spark, sf), "l_suppkey", "y").select("l_suppkey", _r("rate", 9))


@query(f"""WITH d AS (SELECT l_partkey, CAST(l_orderkey % 5 AS INT) AS fold, {Y} AS y FROM lineitem), k AS (SELECT l_partkey, sum(y) AS s, count(*) AS n FROM d GROUP BY 1), q AS (SELECT fold, sum(y) AS s, count(*) AS n FROM d GROUP BY 1),
    c AS (SELECT l_partkey, fold, sum(y) AS s, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT sum(y) AS s, count(*) AS n FROM d)
    SELECT c.l_partkey, c.fold, {R('CASE WHEN k.n > c.n THEN (k.s - c.s + 20 * ((t.s - q.s) / (t.n - q.n))) / (k.n - c.n + 20) ELSE t.s / t.n END', 9)} AS rate FROM c JOIN k USING (l_partkey) JOIN q ON q.fold = c.fold, t""")
def oof_rate_table(spark, sf):
    return rates.out_of_fold_rates(_labelled(spark, sf), "l_partkey", "y", "fold").select("l_partkey", "fold", _r("rate", 9))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 30")
def top_k_frequency(spark, sf):
    return rows.top_k(table(spark, sf, "lineitem"), "l_suppkey", K.TOP_CWES)


@query(f"SELECT {R('median(l_extendedprice)', 4)} AS median_all, {R('median(CASE WHEN l_shipdate < TIMESTAMP ' + chr(39) + '1995-01-01' + chr(39) + ' THEN l_extendedprice END)', 4)} AS median_before FROM lineitem")
def exact_median(spark, sf):
    li = table(spark, sf, "lineitem")
    before = li.where(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    made = {"median_all": rows.exact_median(li, "l_extendedprice"), "median_before": rows.exact_median(before, "l_extendedprice")}
    return spark.range(1).select(*[F.lit(v).cast("double").alias(n) for n, v in made.items()]).select(_r("median_all", 4), _r("median_before", 4))


@query(f"SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, CAST(sum({Y}) AS BIGINT) AS positives, {R(f'sum({Y}) / count(*)')} AS rate FROM lineitem GROUP BY 1")
def yearly_rate(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return li.groupBy(F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("positives"), F.avg("y").alias("rate")).select("year", "n", "positives", _r("rate"))


FLAGS = {"urgent": "o_orderpriority = '1-URGENT'", "open": "o_orderstatus = 'O'", "large": "o_totalprice > 200000"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS flag, {R('avg(CASE WHEN c_mktsegment = ' + chr(39) + 'BUILDING' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS rate FROM orders JOIN customer ON o_custkey = c_custkey WHERE {e}" for n, e in FLAGS.items()))
def flag_rates(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("double"))
    return o.select("y", F.explode(F.array(*[F.when(F.expr(e), F.lit(n)) for n, e in FLAGS.items()])).alias("flag")).where("flag is not null").groupBy("flag").agg(F.avg("y").alias("rate")).select("flag", _r("rate"))


@query(f"WITH h AS (SELECT l_returnflag, CAST(least(floor((l_quantity - 0) / 1.25::DOUBLE), 39) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2) SELECT l_returnflag, bin, n, {R('n / (sum(n) OVER (PARTITION BY l_returnflag) * 1.25::DOUBLE)', 9)} AS density FROM h")
def histogram(spark, sf):
    return rows.histogram(table(spark, sf, "lineitem"), "l_quantity", 0.0, 50.0, 40, by=["l_returnflag"]).select("l_returnflag", "bin", "n", _r("density", 9))


LAG = "date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))"


@query(f"SELECT CAST(median({LAG}) AS DOUBLE) AS median_days, {R(f'avg(CASE WHEN {LAG} > 30 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS late_share FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def lag_stats(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # The tables are joined once; what follows reads a row per lag.
    by_lag = persisted(spark, j.groupBy(F.datediff("l_shipdate", "o_orderdate").alias("lag")).agg(F.count(F.lit(1)).alias("n")), "lags")
    middle = F.lit(rows.exact_median(by_lag, "lag", "n")).cast("double")
    share = F.sum(F.when(F.col("lag") > 30, F.col("n")).otherwise(0)).cast("double") / F.sum("n").cast("double")
    return by_lag.where("lag is not null").agg(share.alias("late_share")).select(middle.alias("median_days"), _r("late_share"))


@query("SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_event(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n"))


# ---- as of a date ------------------------------------------------------------------------------------------------

FREEZE = "1996-01-01"


@query(f"SELECT l_orderkey, l_linenumber, l_shipdate <= TIMESTAMP '{FREEZE}' AS known, l_shipdate > TIMESTAMP '{FREEZE}' AS later FROM lineitem")
def asof_flag(spark, sf):
    t = F.lit(FREEZE).cast("timestamp_ntz")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_shipdate") <= t).alias("known"), (F.col("l_shipdate") > t).alias("later"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate <= least(o_orderdate + INTERVAL 30 DAY, TIMESTAMP '{FREEZE}') THEN 1 ELSE 0 END AS poc, CASE WHEN l_shipdate <= TIMESTAMP '{FREEZE}' THEN 1 ELSE 0 END AS has_poc FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def windowed_flag(spark, sf):
    from triagegrid.operators.asof import poc_exists, poc_in_window

    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = F.lit(FREEZE).cast("timestamp_ntz")
    return j.select("l_orderkey", "l_linenumber", poc_in_window(F.col("l_shipdate"), F.col("o_orderdate"), t).alias("poc"), poc_exists(F.col("l_shipdate"), t).alias("has_poc"))


@query(f"SELECT o_orderkey, CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), DATE '{FREEZE}'), 0) AS INT) AS days FROM orders")
def days_since(spark, sf):
    from triagegrid.operators.asof import days_since as since

    return table(spark, sf, "orders").select("o_orderkey", since(F.col("o_orderdate"), F.lit(FREEZE).cast("date")).alias("days"))


@query("SELECT CASE WHEN year(o_orderdate) BETWEEN 1992 AND 1995 THEN 'train' WHEN year(o_orderdate) = 1996 THEN 'validation' WHEN year(o_orderdate) = 1997 THEN 'test' END AS split, count(*) AS n FROM orders GROUP BY 1")
def time_split(spark, sf):
    from triagegrid.operators.asof import split_of

    return table(spark, sf, "orders").groupBy(split_of(F.year("o_orderdate"), (1992, 1995), 1996, 1997).alias("split")).agg(F.count(F.lit(1)).alias("n"))


# ---- texts and addresses ----------------------------------------------------------------------------------------

WORDS = {"kw_the": r"\bthe\b", "kw_of": r"(?:of|and) the", "kw_tion": r"tion[sh]"}


@query("SELECT doc_id, CAST(length(text) AS INT) AS desc_len, " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN 1 ELSE 0 END AS {n}" for n, p in {**K.KEYWORDS, **WORDS}.items()) + " FROM documents")
def keyword_flags(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length("text").alias("desc_len"), *text.keyword_flags(F.col("text")), *[F.lower("text").rlike(p).cast("int").alias(n) for n, p in WORDS.items()])


@query("SELECT page_id, " + ", ".join(f"CASE WHEN contains(lower(url), '//{d}') OR contains(lower(url), '.{d}') THEN 1 ELSE 0 END AS {n}" for n, d in (("net", "example.net"), ("org", "example.org"), ("com", "example.com"))) + " FROM pages")
def domain_flags(spark, sf):
    u = F.lower("url")
    return table(spark, sf, "pages").select("page_id", *[text.on_domain(u, d).cast("int").alias(n) for n, d in (("net", "example.net"), ("org", "example.org"), ("com", "example.com"))])


@query(r"SELECT doc_id, unnest(regexp_extract_all(text, '\d{4,}')) AS id FROM documents")
def regexp_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d{4,}"), F.lit(0))).alias("id"))


@query("SELECT page_id, lower(regexp_replace(trim(url), '[?#].*', '')) AS key, CAST(len(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS INT) AS links FROM pages")
def url_normalise(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.purl_key(F.col("url")).alias("key"), F.size(F.regexp_extract_all("html", F.lit('href="[^"]*"'), F.lit(0))).alias("links"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT l_orderkey, l_linenumber, CAST((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 2 ELSE 0 END) AS INT) AS mask, l_returnflag = 'R' AS github, l_linestatus = 'O' AS exploitdb FROM lineitem")
def bitmask(spark, sf):
    li = table(spark, sf, "lineitem")
    mask = F.when(F.col("l_returnflag") == "R", 1).otherwise(0) + F.when(F.col("l_linestatus") == "O", 2).otherwise(0)
    return li.select("l_orderkey", "l_linenumber", mask.alias("mask")).select("*", (F.col("mask").bitwiseAND(1) > 0).alias("github"), (F.col("mask").bitwiseAND(2) > 0).alias("exploitdb"))


TOP3 = "[{'i': 0, 'v': l_quantity - 25}, {'i': 1, 'v': l_discount * 100 - 5}, {'i': 2, 'v': l_tax * 100 - 4}, {'i': 3, 'v': CAST(l_linenumber - 4 AS DOUBLE)}]"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, rid, unnest({TOP3}) AS c FROM (SELECT *, row_number() OVER () AS rid FROM lineitem)), r AS (SELECT l_orderkey, l_linenumber, c.i AS i, c.v AS v, row_number() OVER (PARTITION BY rid ORDER BY abs(c.v) DESC, c.i) AS n FROM x WHERE abs(c.v) > 1e-9)
    SELECT l_orderkey, l_linenumber, CAST(n AS INT) AS place, CAST(i AS INT) AS idx, {R('v', 3)} AS value FROM r WHERE n <= 3""")
def top3_per_row(spark, sf):
    from triagegrid.operators.ml import top_contributions

    parts = [F.col("l_quantity") - 25, F.col("l_discount") * 100 - 5, F.col("l_tax") * 100 - 4, (F.col("l_linenumber") - 4).cast("double")]
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(top_contributions(F.array(*parts), 3)).alias("p", "c"))
    return li.select("l_orderkey", "l_linenumber", (F.col("p") + 1).alias("place"), F.col("c.idx").alias("idx"), F.col("c.value").alias("value"))


@query("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 3 END AS tier, CASE WHEN o_orderstatus = 'F' THEN 'Low' ELSE CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' ELSE 'Medium' END END AS criticality FROM orders""")
def asset_normalise(spark, sf):
    from triagegrid.sources.assets import criticality_of, tier_of

    digit = F.substring("o_orderpriority", 1, 1)
    given = F.when(digit == "1", "Critical").when(digit == "2", "High").when(digit == "3", "Medium").otherwise("Low")
    tier = tier_of(F.lit(None).cast("int"), given)
    crit = F.when(F.col("o_orderstatus") == "F", "Low").otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", tier.alias("tier"), criticality_of(crit, tier).alias("criticality"))


@query(f"SELECT event_id, {R('cume_dist() OVER (PARTITION BY event_type ORDER BY value)', 9)} AS percentile FROM events")
def cume_dist(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return ranking.cume_dist(e, "value", by=["event_type"]).select("event_id", half_up(F.col("percentile"), 9).alias("percentile"))


@query("SELECT CAST(year(o_orderdate) AS INT) AS id_year, count(*) AS n FROM orders GROUP BY 1")
def shard_sizes(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("id_year")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag AS reason, array_to_string(list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))), ',') AS ids FROM lineitem GROUP BY 1")
def distinct_id_lists(spark, sf):
    """All ids of each reason in one list. Rows are made distinct by reason and id first, so a list's task gets each id once."""
    ids = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("reason"), F.col("l_suppkey").cast("string").alias("id")).distinct()
    return ids.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM orders")
def counters_and_range(spark, sf):
    return table(spark, sf, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"), F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("open"))


# ---- cross-fitting, versions, rounding ---------------------------------------------------------------------------


NESTED_SQL = f"""WITH d AS (SELECT l_suppkey, CAST(l_orderkey % 3 AS INT) AS fold, CAST(l_partkey % 5 AS INT) AS inner_fold, {Y} AS y FROM lineitem), m AS (SELECT unnest([0, 1, 2, 3]) AS model),
    k AS (SELECT model, l_suppkey, inner_fold, y FROM d JOIN m ON fold <> model)"""


@query(f"""{NESTED_SQL}, p AS (SELECT model, avg(y) AS prior FROM k GROUP BY 1) SELECT CAST(k.model AS INT) AS model, l_suppkey, {R('(sum(y) + 20 * any_value(prior)) / (count(*) + 20)', 9)} AS rate FROM k JOIN p ON p.model = k.model GROUP BY k.model, l_suppkey""")
def nested_rates(spark, sf):
    """Rates of every fold's model, which knows nothing of its fold's rows, from one pass over all rows."""
    return _nested(spark, sf)[0].select("model", "l_suppkey", _r("rate", 9))


@query(f"""{NESTED_SQL}, c AS (SELECT DISTINCT model, l_suppkey, inner_fold FROM k), p AS (SELECT model, avg(y) AS prior FROM k GROUP BY 1), o AS (SELECT a.model, a.inner_fold, avg(b.y) AS others FROM (SELECT DISTINCT model, inner_fold FROM k) a JOIN k b ON b.model = a.model AND b.inner_fold <> a.inner_fold GROUP BY 1, 2),
    r AS (SELECT c.model, c.l_suppkey, c.inner_fold, sum(k.y) AS s, count(k.y) AS n FROM c LEFT JOIN k ON k.model = c.model AND k.l_suppkey = c.l_suppkey AND k.inner_fold <> c.inner_fold GROUP BY 1, 2, 3)
    SELECT CAST(r.model AS INT) AS model, l_suppkey, r.inner_fold AS "inner", {R('CASE WHEN n > 0 THEN (s + 20 * others) / (n + 20) ELSE prior END', 9)} AS rate FROM r JOIN o ON o.model = r.model AND o.inner_fold = r.inner_fold JOIN p ON p.model = r.model""")
def nested_rates_out_of_fold(spark, sf):
    """What each model's own training rows see of their key: nothing of their inner fold, nothing of the fold the model does not know."""
    return _nested(spark, sf)[1].select("model", "l_suppkey", "inner", _r("rate", 9))


def _nested(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_orderkey") % 3).cast("int").alias("fold"), (F.col("l_partkey") % 5).cast("int").alias("inner"))
    return nested.nested_rates(d, "l_suppkey", "y", "fold", "inner", folds=3)


@query("""WITH v AS (SELECT p_brand, p_size AS a, p_partkey % 100 AS b, p_partkey % 7 AS c FROM part WHERE p_partkey % 11 <> 0)
    SELECT p_brand, arg_max(a || '.0' || b || '-' || c, a * 1000000 + b * 1000 + c) AS version FROM v GROUP BY 1""")
def highest_version(spark, sf):
    """The highest of each brand's versions, numbers by value, pre-releases aside."""
    k = F.col("p_partkey")
    said = F.concat(F.col("p_size").cast("string"), F.lit(".0"), (k % 100).cast("string"), F.lit("-"), (k % 7).cast("string"), F.when(k % 11 == 0, "-RC1").otherwise(""))
    per = table(spark, sf, "part").select("p_brand", said.alias("v")).groupBy("p_brand").agg(F.collect_set("v").alias("vs"))
    return per.select("p_brand", versions.highest_version(F.col("vs")).alias("version"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round_even(CAST((l_orderkey % 4096) / 64.0 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS rounded FROM lineitem")
def half_even_rounding(spark, sf):
    """Sixty-fourths with two places, ties to even."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", half_even((F.col("l_orderkey") % 4096) / 64.0, 2).alias("rounded"))
