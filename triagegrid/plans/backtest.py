"""Time-frozen backtest: train on what was known at a date, rank, and measure against what was exploited later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagegrid import constants as K
from triagegrid.functions.numbers import half_even, half_up, sigmoid
from triagegrid.operators import asof, boosting, ml, nested, ranking, rates, scoring
from triagegrid.operators.features import Encoder, poc_flags
from triagegrid.session import discard, persisted


def frozen_scores(spark: SparkSession, table: DataFrame, at: Column, folds: int = K.FOLDS, trees: bool = True, settings: boosting.Settings = boosting.Settings()) -> DataFrame:
    """(cve, p_model): every row scored by a model that saw neither its own label nor anything after the date.

    Training rows are scored by models of the other folds, all others by the
    model of all training rows; each has its own encoder and calibration. Training or
    validation rows without a positive one as of the date: ValueError.
    """
    rows = poc_flags(table, at).withColumn("__y", asof.known(F.col("kev_date_added"), at).cast("int")).withColumn("__split", asof.frozen_split_of(F.col("published"), at))
    rows = rows.withColumn("__f", rates.fold_of(F.col("cve"), folds)).withColumn("__g", rates.fold_of(F.col("cve"), K.FOLDS, seed=43))
    rows = persisted(spark, rows, "backtest-rows")
    seen = {r["__split"]: r["p"] for r in rows.groupBy("__split").agg(F.sum("__y").alias("p")).collect()}
    if not seen.get("train") or not seen.get("validation"):
        raise ValueError("no positive training or validation rows as of the date")
    scored = _by_trees(spark, rows, folds, settings) if trees else _by_lines(rows, folds)
    out = persisted(spark, scored, "frozen-scores")
    discard(spark, rows)
    return out


def _by_trees(spark: SparkSession, rows: DataFrame, folds: int, settings: boosting.Settings) -> DataFrame:
    """All folds' models and the one of all rows at once: one matrix, one fit, one scoring, one calibration."""
    m = nested.matrix(rows, "__y", "__split", "__f", "__g", folds).withColumn("key", F.xxhash64("cve"))
    m = persisted(spark, m, "backtest-matrix")
    models = boosting.fit(spark, m.where("role <> 'score'"), settings)
    done = boosting.score(m.where("role <> 'train'").select("model", "role", "cve", "y", "x"), models)
    done = persisted(spark, done.drop("x"), "backtest-margins")
    lines = boosting.platt(done.where("role = 'validation'"))
    line = F.coalesce(*[F.when(F.col("model") == k, F.array(F.lit(a), F.lit(b))) for k, (a, b) in lines.items()])
    discard(spark, m)
    return done.where("role = 'score'").select("cve", sigmoid(F.col("margin") * line[0] + line[1]).alias("p_model"))


def _by_lines(rows: DataFrame, folds: int) -> DataFrame:
    train, validation = rows.where("__split = 'train'"), rows.where("__split = 'validation'")

    def fit_and_score(fit_on: DataFrame, score_on: DataFrame) -> DataFrame:
        enc = Encoder(fit_on, "__y")
        model = ml.fit_logistic(enc.transform(fit_on, out_of_fold=True), enc.names(), "__y")
        seen = model.transform(enc.transform(validation))
        platt = ml.calibrate(seen.select(ml.margin(seen, model).alias("__margin"), "__y"), "__margin", "__y")
        out = model.transform(enc.transform(score_on))
        return out.select("cve", ml.probability(ml.margin(out, model), platt).alias("p_model"))

    done = fit_and_score(train, rows.where("__split is null or __split <> 'train'"))
    for k in range(folds):
        done = done.unionByName(fit_and_score(train.where(F.col("__f") != k), train.where(F.col("__f") == k)))
    return done


def frozen_intel(table: DataFrame, scores: DataFrame, at: Column) -> DataFrame:
    """What was known of each CVE at the date, and what became known later."""
    flagged = poc_flags(table, at).join(scores, "cve", "left")
    return flagged.select(
        "cve", "published", "p_model", F.coalesce("epss_t", F.lit(0.0)).alias("epss"), F.col("epss_t").isNotNull().alias("epss_scored"), asof.known(F.col("kev_date_added"), at).alias("kev"), asof.later(F.col("kev_date_added"), at).alias("exploited_later"),
        (asof.poc_exists(F.col("poc_github_first"), at) == 1).alias("poc_github"), (asof.poc_exists(F.col("poc_exploitdb_first"), at) == 1).alias("poc_exploitdb"), "cvss_base", "cvss_impact", F.coalesce("cvss_scope_changed", F.lit(False)).alias("scope_changed"),
    )


def population(intel: DataFrame, at: Column, scored_only: bool = True) -> DataFrame:
    """All CVEs published before the date, as findings without an application."""
    rows = intel.where((F.col("published") < at) & F.col("p_model").isNotNull())
    if scored_only:
        rows = rows.where("epss_scored")
    return rows.select("*", F.lit(0).alias("fanin"), F.lit(0).alias("max_fanin"), F.lit(False).alias("has_context"), F.array().cast(scoring._SERVICES).alias("services"), F.lit(None).cast("string").alias("maturity_override"))


def freeze_findings(matched: DataFrame, intel: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(findings that were there at the date, excluded): what an application's matched findings were then.

    excluded(reason, cve) has a row for each CVE left out: published_after for those
    published at the date or later, unknown for those without a record. The
    scores of kept findings are the record's where it has an impact.
    """
    known = intel.select(F.col("cve").alias("__cve"), F.col("published").alias("__published"), F.col("cvss_base").alias("__base"), F.col("cvss_impact").alias("__impact"), F.col("scope_changed").alias("__scope"), F.col("exploited_later").alias("__later"))
    j = matched.join(known, matched["cve_id"] == F.col("__cve"), "left")
    reason = F.when(F.col("__cve").isNull(), "unknown").when(F.coalesce(F.col("__published") >= at, F.lit(False)), "published_after")
    j = j.withColumn("__reason", reason)
    scored = F.col("__impact").isNotNull()
    own = {"cvss_base": F.when(scored, F.col("__base")).otherwise(F.col("cvss_base")), "cvss_impact": F.coalesce("__impact", "cvss_impact"), "scope_changed": F.when(scored, F.col("__scope")).otherwise(F.col("scope_changed")), "vector_source": F.when(scored, "nvd").otherwise(F.col("vector_source"))}
    kept = j.where("__reason is null").select(*[own[c].alias(c) if c in own else F.col(c) for c in matched.columns], F.col("__later").alias("exploited_later"))
    return kept, j.where("__reason is not null").select(F.col("__reason").alias("reason"), F.col("cve_id").alias("cve")).distinct()


def headline(all_rows: DataFrame, case: str = "case") -> DataFrame:
    """(case, effort_formula, effort_cvss, saved): the part of the list to work through for nine tenths, and how much less of it than by CVSS alone."""
    by = lambda r, n: all_rows.where(F.col("ranker") == r).select(case, F.col("effort_90").alias(n))
    return by("ml", "effort_formula").join(by("cvss", "effort_cvss"), case).withColumn("saved", half_up(F.col("effort_cvss") - F.col("effort_formula"), 4))


def evaluate(findings: DataFrame, label: str = "exploited_later", at: Sequence[int] = (10, 25), case: str = "case") -> dict[str, DataFrame]:
    """Metrics of five rankers, on all findings and on those not known to be exploited, and of every ablation; coverage curves and the floor of scores; one plan each.

    findings may hold several cases, told apart by the column `case` if it exists.
    What needs a context (fan-in, assets) cannot be left out of a case without one: effort and
    delta are null there. curves(case, ranker, point, worked, covered) has four places; floor(case, value, n, share,
    positives) is of the EPSS scores, whose lowest value many findings share.
    """
    df = findings if case in findings.columns else findings.withColumn(case, F.lit("all"))
    rankers = {"cvss": scoring.severity(F.col("cvss_base"))["raw"], "legacy": scoring.legacy()["raw"], "ml": scoring.combined()["raw"], "epss": F.col("epss"), "model": F.col("p_model")}
    drops = {d or "full": scoring.combined((d,) if d else ())["raw"] for d in ("", *K.ABLATIONS)}
    key = [case, "ranker"]

    def blocks(rows: DataFrame, scores: dict[str, Column]) -> DataFrame:
        long = rows.select(case, F.col(label).cast("int").alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("ranker"), s.cast("double").alias("score")) for n, s in scores.items()])).alias("r")).select(case, "y", "r.*")
        return ranking.tied_blocks(long, "score", "y", by=key)

    measured = lambda b: ranking.report(b, by=key, at=at, recall=at, efforts=(0.5, 0.75, 0.9))
    ablation = measured(blocks(df, drops))
    full = ablation.where("ranker = 'full'").select(case, F.col("effort_90").alias("__full"))
    context = df.groupBy(case).agg(F.max("has_context").alias("__context"))
    ablation = ablation.join(F.broadcast(full), case, "left").join(F.broadcast(context), case, "left")
    ablation = ablation.withColumn("effort_90", F.when(~F.col("ranker").isin(*K.CONTEXT_ABLATIONS) | F.coalesce("__context", F.lit(False)), F.col("effort_90")))
    ablation = ablation.withColumn("delta", half_up(F.col("effort_90") - F.col("__full"), 4)).drop("__full", "__context")
    every = blocks(df, rankers)
    curves = ranking.coverage_curve(every, by=key).select(*key, "point", half_even(F.col("worked"), 4).alias("worked"), half_even(F.col("covered"), 4).alias("covered"))
    floor = ranking.floor_block(df.select(case, F.col("epss").cast("double").alias("epss"), F.col(label).cast("int").alias("y")), "epss", "y", by=[case])
    return {"all": measured(every), "open": measured(blocks(df.where("not kev"), rankers)), "ablation": ablation, "curves": curves, "floor": floor}


def top_findings(ranked: DataFrame, k: int = 15, label: str = "exploited_later") -> DataFrame:
    """The first k findings, those exploited later first, each by rank."""
    return ranked.orderBy(F.desc(label), "rank", "cve").limit(k)


def gate(auc: float | None, synthetic: bool, backtested: bool) -> list[str]:
    """Reasons against publishing a model; none if it may be."""
    out = []
    if auc is None or auc <= K.MIN_TEST_AUC:
        out.append(f"test AUC {auc} is not above {K.MIN_TEST_AUC}")
    if synthetic:
        out.append("trained on synthetic data")
    if not backtested:
        out.append("no backtest")
    return out


def write_ablation(ablation: DataFrame, path: str) -> None:
    """CSV with four places, signed differences, blanks for nulls."""
    four = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, c))
    ablation.select("case", F.col("ranker").alias("variant"), four("effort_90", "%.4f").alias("effort_90"), four("delta", "%+.4f").alias("delta")).write.csv(path, header=True, nullValue="", mode="overwrite")


def write_shards(intel: DataFrame, path: str, files: int = 8) -> None:
    """Intelligence by the year in the CVE's name, so that a lookup reads its year's files alone."""
    mask = F.col("poc_github").cast("int") + F.col("poc_exploitdb").cast("int") * 2
    rounded = lambda c, n: half_even(F.nanvl(c, F.lit(None).cast("double")), n).alias(c)
    rows = intel.select("cve", rounded("p_model", 5), rounded("epss", 5), "kev", mask.alias("poc_mask"), rounded("cvss_impact", 1), "scope_changed", rounded("cvss_base", 1), F.substring("cve", 5, 4).cast("int").alias("id_year"))
    # A year's rows are dealt over a few tasks, so that the largest year is not one task's.
    rows.repartition("id_year", F.pmod(F.xxhash64("cve"), F.lit(files))).write.partitionBy("id_year").mode("overwrite").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("poc_github", F.col("poc_mask").bitwiseAND(1) > 0).withColumn("poc_exploitdb", F.col("poc_mask").bitwiseAND(2) > 0)


def lookup(shards: DataFrame, findings: DataFrame, key: str = "cve_id") -> DataFrame:
    """findings with what the shards of read_shards() know of their CVE, null where they know nothing.

    Which years are read is told at run time by the findings' own years (at most one
    for each four digits, broadcast), so shards of other years are not opened.
    """
    year = F.col(key).substr(5, 4).try_cast("int")
    years = findings.where(F.col(key).like("CVE-%-%")).select(year.alias("id_year")).where("id_year is not null").distinct()
    known = shards.join(F.broadcast(years), "id_year", "left_semi").drop("id_year")
    return findings.join(known, findings[key] == known["cve"], "left").drop("cve")
