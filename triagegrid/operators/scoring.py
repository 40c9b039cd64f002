"""The three scores of a finding, as struct columns, and ranks.

A finding has: cvss_base, cvss_impact, scope_changed, p_model, epss, kev,
poc_github, poc_exploitdb, maturity_override, fanin, max_fanin, has_context and
services, an array of (name, tier, criticality, internet_facing, handles_pii).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.functions.numbers import half_up, or_zero, risk_tier, soft_ceiling
from triagegrid.operators import rows


def _pick(key: Column, values: dict, default: float | None = None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def severity(base: Column) -> Column:
    raw = half_up(or_zero(base) * 10.0, 2)
    return F.struct(raw.alias("raw"), raw.alias("risk"), risk_tier(raw).alias("tier"))


def criticality_multiplier(services: Column, has_context: Column, drop: Sequence[str] = ()) -> Column:
    """Largest multiplier of the services; the default tier's without any, 1 without a context."""
    if "asset" in drop:
        return F.lit(1.0)
    one = lambda s: _pick(s["tier"], K.TIER_MULTIPLIER) * F.when(s["internet_facing"], F.lit(K.INTERNET_FACING)).otherwise(1.0) * F.when(s["handles_pii"], F.lit(K.HANDLES_PII)).otherwise(1.0)
    best = F.array_max(F.transform(services, one))
    return F.when(~F.coalesce(has_context, F.lit(False)), F.lit(1.0)).when(F.coalesce(F.size(services), F.lit(0)) <= 0, F.lit(K.TIER_MULTIPLIER[K.DEFAULT_TIER])).otherwise(best)


def combined(drop: Sequence[str] = ()) -> Column:
    """Likelihood times impact times scope under a soft ceiling; each name in drop makes one signal neutral."""
    zero = F.lit(0.0)
    p = zero if "model" in drop else or_zero(F.col("p_model"))
    e = zero if "epss" in drop else or_zero(F.col("epss"))
    k = zero if "kev" in drop else F.when(F.col("kev"), F.lit(1.0)).otherwise(0.0)
    likelihood = p * K.MODEL_WEIGHT + e * K.EPSS_WEIGHT + k * K.KEV_WEIGHT
    cvss = F.least(F.lit(1.0), or_zero(F.col("cvss_impact")) / K.IMPACT_MAX)
    fanin = zero if "fanin" in drop else F.when(or_zero(F.col("max_fanin")) > 0, or_zero(F.col("fanin")) / or_zero(F.col("max_fanin"))).otherwise(0.0)
    crit = criticality_multiplier(F.col("services"), F.col("has_context"), drop)
    impact = (cvss * K.IMPACT_WEIGHT + fanin * K.FANIN_WEIGHT) * crit
    scope = F.lit(1.0) if "scope" in drop else F.when(F.col("scope_changed"), F.lit(K.SCOPE_CHANGED)).otherwise(1.0)
    raw = F.lit(100.0) * likelihood * impact * scope
    risk = soft_ceiling(raw)
    return F.struct(
        likelihood.alias("likelihood"), cvss.alias("cvss_term"), fanin.alias("fanin_term"), crit.alias("crit_mult"),
        impact.alias("impact"), scope.alias("scope_mult"), raw.alias("raw"), risk.alias("risk"), risk_tier(risk).alias("tier"),
    )


def maturity_label() -> Column:
    """kev, else an override, else weaponized or poc by where an exploit is public, else none."""
    given = F.col("maturity_override")
    return F.when(F.col("kev"), "kev").when(given.isin("none", "poc", "weaponized"), given).when(F.col("poc_exploitdb"), "weaponized").when(F.col("poc_github"), "poc").otherwise("none")


def legacy() -> Column:
    """The older formula with its rounding in between."""
    services = F.col("services")
    some = F.coalesce(F.size(services), F.lit(0)) > 0
    weight = F.aggregate(F.coalesce(services, F.array().cast(_SERVICES)), F.lit(0.0), lambda acc, s: acc + _pick(s["criticality"], K.CRITICALITY_WEIGHT, 0.0))
    business = F.least(F.lit(1.0), weight / K.BUSINESS_DIVISOR)
    fanin = or_zero(F.col("fanin"))
    graph = F.least(F.lit(1.0), fanin / K.FANIN_DIVISOR)
    blast = half_up(F.when(some, business * K.BUSINESS_SHARE + graph * (1 - K.BUSINESS_SHARE)).otherwise(graph), 3)
    label = maturity_label()
    likelihood = half_up(or_zero(F.col("epss")) * K.OLD_EPSS_WEIGHT + _pick(label, K.MATURITY) * K.OLD_MATURITY_WEIGHT, 4)
    impact = half_up(F.least(F.lit(1.0), or_zero(F.col("cvss_impact")) / K.IMPACT_MAX) * K.OLD_IMPACT_WEIGHT + blast * K.OLD_BLAST_WEIGHT, 4)
    crosses = (F.coalesce(F.size(services), F.lit(0)) >= 3) | (fanin >= 3)
    scope = F.when(F.col("scope_changed"), F.lit(K.SCOPE_CHANGED)).when(crosses, F.lit(K.TRUST_BOUNDARY)).otherwise(1.0)
    raw = likelihood * impact * 100.0 * scope
    risk = half_up(soft_ceiling(raw), 2)
    return F.struct(
        likelihood.alias("likelihood"), impact.alias("impact"), blast.alias("blast_radius"), label.alias("maturity_label"),
        crosses.alias("crosses_trust_boundary"), scope.alias("scope_mult"), raw.alias("raw"), risk.alias("risk"), risk_tier(risk).alias("tier"),
    )


_SERVICES = "array<struct<name:string,tier:int,criticality:string,internet_facing:boolean,handles_pii:boolean,components:array<string>,hosts:array<string>>>"


def rank(df: DataFrame, raw: str, base: str, ids: Sequence[str], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Row numbers by raw, then base, both falling, then the ids; with by, within each application."""
    w = Window.partitionBy(*by).orderBy(F.desc(raw), F.desc(base), *ids)
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def score_all(spark: SparkSession, findings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """findings with the structs cvss, legacy and ml, each with a rank, within each application if by is given.

    With by, an application's findings are one task's work, as its documents are; rows that stand together by `by` are not dealt anew.
    """
    out = findings.withColumn("cvss", severity(F.col("cvss_base"))).withColumn("legacy", legacy()).withColumn("ml", combined())
    for mode in ("cvss", "legacy", "ml"):
        order = [F.desc(f"{mode}.raw"), F.desc(F.coalesce("cvss_base", F.lit(0.0))), F.asc("cve_id"), F.asc("component_ref")]
        placed = rows.ranked(spark, out, order, name="__rank") if not by else out.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
        out = placed.withColumn(mode, F.col(mode).withField("rank", F.col("__rank"))).drop("__rank")
    return out
