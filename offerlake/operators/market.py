"""Market aggregates and sort/top-k/dedup.

All functions are DataFrame -> DataFrame and take column names as parameters.
Medians and quantiles go through ``exact_quantiles`` (exact, one path at
every size, no group gathered into one task). One-row global statistics enter other plans as scalar
subqueries (``DataFrame.scalar()``), which Spark evaluates once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.operators.quantiles import exact_quantiles, median_by

# Experience bins, left-closed (salary ranges) and right-closed (band stats).
EXPERIENCE_RANGE_BINS = ((0, 1), (1, 3), (3, 5), (5, 8), (8, 12), (12, 30))
EXPERIENCE_BAND_EDGES = (0, 1, 3, 5, 8, 12, 30)
EXPERIENCE_BAND_LABELS = ("<1 an", "1-3 ans", "3-5 ans", "5-8 ans", "8-12 ans", "12+ ans")

# Months needed to learn a skill (market ROI table).
SKILL_LEARNING_MONTHS = {
    "sql": 4, "tableau": 4, "power_bi": 5, "python": 6, "r": 6, "aws": 8,
    "azure": 8, "gcp": 8, "spark": 9, "machine_learning": 10, "deep_learning": 12,
}


def _global(df: DataFrame, expr: Column) -> Column:
    """A one-row aggregate as a scalar subquery column."""
    return df.select(expr).scalar()


def _flag(df: DataFrame, col: str | None) -> Column:
    """0/1 flag; a skill without a column counts as absent (as a missing key does)."""
    if col is None or col not in df.columns:
        return F.lit(0)
    return F.coalesce(F.col(col).cast("int"), F.lit(0))


def flag_counts(df: DataFrame, flags: list[Column], value: str) -> DataFrame:
    """(mask, value) -> n: the flags of a row packed into one integer (bit i = flag i), rows
    pre-aggregated once for all flags. Per-flag statistics unpivot this table, never the rows."""
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(f.cast("long"), i) for i, f in enumerate(flags)])
    return df.select(mask.alias("mask"), F.col(value).alias("v")).groupBy("mask", "v").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- A1
def salary_summary(df: DataFrame, value: str = "salary_mid") -> DataFrame:
    """mean, median, population std, Q1, Q3, IQR, min, max (+ count)."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    moments = df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                     F.min(value).alias("min"), F.max(value).alias("max"),
                     F.count(value).alias("count"))
    return q.select(
        _global(moments, F.col("mean")).alias("mean"), "median",
        _global(moments, F.col("std")).alias("std"), "q1", "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        _global(moments, F.col("min")).alias("min"),
        _global(moments, F.col("max")).alias("max"),
        _global(moments, F.col("count")).alias("count"))


# --------------------------------------------------------------------------- A2
def market_kpis(filtered: DataFrame, full: DataFrame, value: str = "salary_mid",
                skills_count: str = "skills_count", telework: str | None = None) -> DataFrame:
    """Filtered count, % of all rows, median and its delta vs the global median,
    mean, mean skill count, % with telework > 0 (NULL counts as no)."""
    fmed = median_by(filtered, value, name="median_salary")
    gmed = median_by(full, value, name="g").select("g")
    stats = filtered.agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_salary"),
        F.avg(skills_count).alias("mean_skills"),
        (F.avg(F.coalesce(F.col(telework) > 0, F.lit(False)).cast("double")) * 100
         if telework else F.lit(None).cast("double")).alias("telework_pct"))
    n_all = _global(full, F.count(F.lit(1)))
    g = gmed.scalar()
    return fmed.select(
        _global(stats, F.col("n")).alias("n_offers"),
        (_global(stats, F.col("n")) * 100.0 / n_all).alias("pct_of_total"),
        "median_salary",
        (F.col("median_salary") - g).alias("median_delta"),
        _global(stats, F.col("mean_salary")).alias("mean_salary"),
        _global(stats, F.col("mean_skills")).alias("mean_skills"),
        _global(stats, F.col("telework_pct")).alias("telework_pct"))


# --------------------------------------------------------------------------- A3 / A19 / T1
def top_groups(df: DataFrame, group: str, value: str = "salary_mid", k: int = 10) -> DataFrame:
    """value_counts().head(k) with the mean value of each group; NULL keys excluded;
    ties broken by key. The limit is the feature (a top-k report)."""
    return (df.where(F.col(group).isNotNull())
            .groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_salary"))
            .orderBy(F.col("n").desc(), F.col(group).asc()).limit(k))


# --------------------------------------------------------------------------- A4 / J1
def group_multiplier(df: DataFrame, group: str, value: str = "salary_mid") -> DataFrame:
    """median(group) / median(all), over rows with a value."""
    rows = df.where(F.col(value).isNotNull())
    g = median_by(rows, value, name="g").select("g").scalar()
    per = median_by(rows.where(F.col(group).isNotNull()), value, [group], name="group_median")
    return per.select(group, "group_median", (F.col("group_median") / g).alias("multiplier"))


# --------------------------------------------------------------------------- A5
def group_iqr_range(df: DataFrame, group: str, value: str = "salary_mid",
                    min_count: int = 10) -> DataFrame:
    """P25/P75 truncated to int for groups with >= min_count rows (NULL key skipped)."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = exact_quantiles(rows, value, [0.25, 0.75], [group], ["p25", "p75"])
    return q.where(F.col("_count") >= min_count).select(
        group, F.col("p25").cast("long").alias("p25"), F.col("p75").cast("long").alias("p75"),
        F.col("_count").alias("n"))


def experience_range_bin(exp: Column) -> Column:
    """Left-closed bins [lo, hi); label 'lo-hi'."""
    return reduce(lambda acc, b: acc.when((exp >= b[0]) & (exp < b[1]), F.lit(f"{b[0]}-{b[1]}")),
                  EXPERIENCE_RANGE_BINS[1:],
                  F.when((exp >= EXPERIENCE_RANGE_BINS[0][0]) & (exp < EXPERIENCE_RANGE_BINS[0][1]),
                         F.lit(f"{EXPERIENCE_RANGE_BINS[0][0]}-{EXPERIENCE_RANGE_BINS[0][1]}")))


# --------------------------------------------------------------------------- A6
def experience_range(df: DataFrame, experience: str = "experience", value: str = "salary_mid",
                     min_count: int = 10) -> DataFrame:
    binned = df.where(F.col(value).isNotNull()).withColumn(
        "exp_bin", experience_range_bin(F.col(experience)))
    return group_iqr_range(binned, "exp_bin", value, min_count)


def experience_band(exp: Column) -> Column:
    """Right-closed bands with the lowest edge included: [0,1] (1,3] ... (12,30]."""
    e = EXPERIENCE_BAND_EDGES
    out = F.when((exp >= e[0]) & (exp <= e[1]), F.lit(EXPERIENCE_BAND_LABELS[0]))
    for i in range(1, len(EXPERIENCE_BAND_LABELS)):
        out = out.when((exp > e[i]) & (exp <= e[i + 1]), F.lit(EXPERIENCE_BAND_LABELS[i]))
    return out


# --------------------------------------------------------------------------- A7
def experience_band_stats(df: DataFrame, experience: str = "experience",
                          value: str = "salary_mid") -> DataFrame:
    """median, mean, count per band; rows outside the bands (or NULL) dropped."""
    banded = df.withColumn("exp_band", experience_band(F.col(experience))) \
        .where(F.col("exp_band").isNotNull())
    return _median_mean_count(banded, "exp_band", value)


def _median_mean_count(df: DataFrame, group: str, value: str) -> DataFrame:
    med = median_by(df, value, [group], name="median")
    mc = df.groupBy(group).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    return mc.join(med.drop("_count"), group, "left").select(group, "median", "mean", "count")


# --------------------------------------------------------------------------- A8
def city_stats(df: DataFrame, city: str = "location", value: str = "salary_mid",
               min_count: int = 3) -> DataFrame:
    """median, mean, non-null count per city; count >= min_count; NULL city dropped."""
    rows = df.where(F.col(city).isNotNull())
    return _median_mean_count(rows, city, value).where(F.col("count") >= min_count)


# --------------------------------------------------------------------------- A9
def best_groups(df: DataFrame, group: str, value: str = "salary_mid", min_count: int = 5,
                k: int = 3) -> DataFrame:
    """Top k groups by median among groups with >= min_count values."""
    rows = df.where(F.col(group).isNotNull())
    stats = _median_mean_count(rows, group, value).where(F.col("count") >= min_count)
    return (stats.select(group, "median", "count")
            .orderBy(F.col("median").desc(), F.col(group).asc()).limit(k))


# --------------------------------------------------------------------------- A10 / J6
def city_sector_pivot(df: DataFrame, city: str = "location", sector: str = "sector",
                      value: str = "salary_mid", top_cities: int = 10, top_sectors: int = 8,
                      min_rows: int = 20, wide: list | None = None) -> DataFrame:
    """Median per (city, sector) over the top cities by median x the most frequent
    sectors; empty when fewer than ``min_rows`` rows remain. Long form by default; with
    ``wide``, the sectors to show, one row per city and one column per sector."""
    cities = city_stats(df, city, value).orderBy(F.col("median").desc(), F.col(city)) \
        .limit(top_cities).select(city)
    sectors = (df.where(F.col(sector).isNotNull()).groupBy(sector).count()
               .orderBy(F.col("count").desc(), F.col(sector)).limit(top_sectors).select(sector))
    # Both key sets are bounded by k, so the semi joins broadcast a proven-small side.
    kept = (df.join(F.broadcast(cities), city, "left_semi")
            .join(F.broadcast(sectors), sector, "left_semi"))
    n_kept = kept.select(F.count(F.lit(1))).scalar()
    cells = median_by(kept.where(F.col(value).isNotNull()), value, [city, sector], name="median") \
        .where(n_kept >= min_rows).select(city, sector, "median")
    if wide:
        return cells.groupBy(city).pivot(sector, wide).agg(F.first("median"))
    return cells


# --------------------------------------------------------------------------- A11
def skill_frequency(df: DataFrame, skills: list[tuple[str, str]]) -> DataFrame:
    """Share of rows holding each skill, x100, most frequent first."""
    bound = [(n, c) for n, c in skills if c in df.columns]
    one = df.agg(*[(F.avg(_flag(df, c)) * 100).alias(n) for n, c in bound])
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("skill"), F.col(n).cast("double").alias("frequency_pct"))
        for n, _ in bound])).alias("s")).select("s.*")
    return stacked.orderBy(F.col("frequency_pct").desc(), "skill")


# --------------------------------------------------------------------------- A12 / T2
def skill_impact(df: DataFrame, skills: list[tuple[str, str]], value: str = "salary_mid",
                 min_holders: int = 5, drop_zero: bool = False, top: int | None = None,
                 by_abs: bool = True) -> DataFrame:
    """median(value | skill) - median(value | no skill) per skill with >= min_holders
    holders. Variants: sorted by absolute impact (default), or dropping zero
    impacts and keeping the ``top`` largest (``by_abs=False``)."""
    bound = [(n, c) for n, c in skills if c in df.columns]
    bits = F.explode(F.array(*[F.struct(F.lit(n).alias("skill"), F.shiftright("mask", i).bitwiseAND(1).alias("flag"))
                               for i, (n, _) in enumerate(bound)]))
    counts = flag_counts(df, [_flag(df, c) for _, c in bound], value)
    pairs = counts.select("v", "n", bits.alias("_p")).select("v", "n", "_p.skill", "_p.flag")
    holders = pairs.groupBy("skill").agg(F.sum(F.col("n") * F.col("flag")).alias("holders"))
    med = exact_quantiles(pairs, "v", [0.5], ["skill", "flag"], ["median"], weight="n")
    wide = med.groupBy("skill").agg(
        F.max(F.when(F.col("flag") == 1, F.col("median"))).alias("median_with"),
        F.max(F.when(F.col("flag") == 0, F.col("median"))).alias("median_without"))
    out = (wide.join(holders, "skill")
           .where(F.col("holders") >= min_holders)
           .select("skill", "holders", "median_with", "median_without",
                   (F.col("median_with") - F.col("median_without")).alias("impact"))
           .where(F.col("impact").isNotNull()))
    if drop_zero:
        out = out.where(F.col("impact") != 0)
    out = out.orderBy(F.abs("impact").desc() if by_abs else F.col("impact").desc(), "skill")
    return out.limit(top) if top else out


# --------------------------------------------------------------------------- A13
def skill_roi(df: DataFrame, skills: list[tuple[str, str]], value: str = "salary_mid",
              min_holders: int = 5, months: dict | None = None) -> DataFrame:
    """impact / learning months for skills that have a months entry."""
    months = months or SKILL_LEARNING_MONTHS
    spark = df.sparkSession
    dim = spark.createDataFrame([(k, int(v)) for k, v in months.items()],
                                "skill string, learning_months int")
    imp = skill_impact(df, skills, value, min_holders)
    # the months table is a fixed dimension (11 rows): broadcasting it is bounded
    return (imp.join(F.broadcast(dim), "skill")
            .select("skill", "impact", "learning_months",
                    (F.col("impact") / F.col("learning_months")).alias("roi_per_month"))
            .orderBy(F.col("roi_per_month").desc(), "skill"))


# --------------------------------------------------------------------------- A14
def stack_predicates(df: DataFrame, skill_of) -> dict[str, Column]:
    """The five named, overlapping stacks. ``skill_of(name)`` -> column or None."""
    s = {n: _flag(df, skill_of(n)) == 1 for n in (
        "python", "machine_learning", "aws", "azure", "gcp", "spark", "sql", "tableau", "power_bi")}
    return {
        "Data Scientist (Full Stack)": s["python"] & s["machine_learning"] & (s["aws"] | s["azure"] | s["gcp"]),
        "Data Engineer (Cloud)": s["python"] & s["spark"] & (s["aws"] | s["azure"]),
        "BI Analyst": s["sql"] & (s["tableau"] | s["power_bi"]),
        "ML Engineer": s["python"] & s["machine_learning"] & s["spark"],
        "Full Stack Data": s["python"] & s["sql"] & (s["aws"] | s["azure"] | s["gcp"]),
    }


def export_stacks(df: DataFrame, skill_of) -> dict[str, Column]:
    """The three stacks of the market export (looser than the five above)."""
    s = {n: _flag(df, skill_of(n)) == 1 for n in (
        "python", "machine_learning", "aws", "azure", "spark", "sql", "tableau", "power_bi")}
    # fixed values: the rules of the export
    return {
        "Data Scientist": s["python"] & s["machine_learning"] & (s["aws"] | s["azure"]),
        "Data Engineer": s["python"] & s["spark"],
        "BI Analyst": s["sql"] & (s["tableau"] | s["power_bi"]),
    }


def stack_stats(df: DataFrame, skill_of, value: str = "salary_mid", min_count: int = 5,
                stacks=stack_predicates) -> DataFrame:
    """Per stack: median, mean, Q25, Q75 of value and the number of matching rows."""
    preds = stacks(df, skill_of)
    counts = flag_counts(df, [p.cast("int") for p in preds.values()], value)
    tagged = counts.select("v", "n", F.explode(F.filter(
        F.array(*[F.when(F.shiftright("mask", i).bitwiseAND(1) == 1, F.lit(name)) for i, name in enumerate(preds)]),
        lambda x: x.isNotNull())).alias("stack"))
    q = exact_quantiles(tagged, "v", [0.5, 0.25, 0.75], ["stack"], ["median", "q25", "q75"], weight="n")
    known = F.when(F.col("v").isNotNull(), F.col("n"))
    agg = tagged.groupBy("stack").agg((F.sum(F.col("v") * F.col("n")) / F.sum(known)).alias("mean"), F.sum("n").alias("n"))
    return (agg.where(F.col("n") >= min_count).join(q.drop("_count"), "stack", "left")
            .select("stack", "median", "mean", "q25", "q75", "n"))


# --------------------------------------------------------------------------- A15
def distribution_profile(df: DataFrame, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """P10/25/50/75/90 and mean truncated to int, plus the count of non-null values."""
    by = list(by)
    q = exact_quantiles(df, value, [0.1, 0.25, 0.5, 0.75, 0.9], by,
                        ["p10", "p25", "median", "p75", "p90"])
    m = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"))
    joined = q.join(m, by, "left") if by else q.select("*", m.select("mean").scalar().alias("mean"))
    return joined.select(*by, *[F.col(c).cast("long").alias(c) for c in
                                ["p10", "p25", "median", "p75", "p90", "mean"]],
                         F.col("_count").alias("count"))


# --------------------------------------------------------------------------- A16
def flag_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(F.coalesce(F.col(a).cast("double"), F.lit(0.0)),
                         F.coalesce(F.col(b).cast("double"), F.lit(0.0))).alias("correlation"))


# --------------------------------------------------------------------------- A17
def regression_slope(df: DataFrame, y: str, x: str, default: float, min_pairs: int = 10,
                     name: str = "slope") -> DataFrame:
    """OLS slope of y on x over complete pairs; fewer than min_pairs -> default."""
    return df.agg(
        F.when(F.regr_count(F.col(y), F.col(x)) < min_pairs, F.lit(float(default)))
        .otherwise(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double"))).alias(name),
        F.regr_count(F.col(y), F.col(x)).alias("pairs"))


# --------------------------------------------------------------------------- A18
def high_paying_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose median >= P75 of the group medians (two-level aggregate)."""
    med = median_by(df, value, [group], name="median").where(F.col("median").isNotNull())
    p75 = exact_quantiles(med, "median", [0.75], names=["p75"]).select("p75").scalar()
    return med.where(F.col("median") >= p75).select(group, "median")


# --------------------------------------------------------------------------- A20
def group_adjustments(df: DataFrame, group: str, value: str) -> DataFrame:
    """int(group median - global median) per group with a median."""
    g = median_by(df, value, name="g").select("g").scalar()
    per = median_by(df, value, [group], name="median")
    return per.where(F.col("median").isNotNull()).select(
        group, (F.col("median") - g).cast("long").alias("adjustment"))


# --------------------------------------------------------------------------- A21
def histogram(df: DataFrame, value: str = "salary_mid", bins: int = 25) -> DataFrame:
    """Equal-width bins between min and max; exactly ``bins`` bins (empty ones kept)."""
    rows = df.where(F.col(value).isNotNull())
    lo = _global(rows, F.min(value))
    hi = _global(rows, F.max(value))
    width = (hi - lo) / F.lit(bins)
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = rows.select(F.when(width == 0, F.lit(0)).otherwise(b).alias("bin")) \
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (all_bins.join(counts, "bin", "left")
            .select("bin", (lo + F.col("bin") * width).alias("lower"),
                    (lo + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .where(lo.isNotNull()))


# --------------------------------------------------------------------------- A22
def boxplot_stats(df: DataFrame, group: str, value: str = "salary_mid") -> DataFrame:
    """Five-number summary per group, whiskers at the most extreme values inside
    the 1.5 IQR fences, and the number of outliers."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = exact_quantiles(rows, value, [0.25, 0.5, 0.75], [group], ["q1", "median", "q3"]) \
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    j = rows.join(q.select(group, "q1", "q3", "iqr"), group)
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    v = F.col(value)
    agg = j.groupBy(group).agg(
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.min(F.when(v >= lo_f, v)).alias("lower_whisker"),
        F.max(F.when(v <= hi_f, v)).alias("upper_whisker"),
        F.sum(F.when((v < lo_f) | (v > hi_f), 1).otherwise(0)).cast("long").alias("n_outliers"))
    return q.join(agg, group).select(group, "min", "q1", "median", "q3", "max",
                                     "lower_whisker", "upper_whisker", "n_outliers",
                                     F.col("_count").alias("n"))


# --------------------------------------------------------------------------- A23
def market_quantiles(df: DataFrame, value: str = "salary_mid") -> DataFrame:
    q = exact_quantiles(df, value, [0.5, 0.25, 0.75, 0.01, 0.99],
                        names=["median", "q1", "q3", "p1", "p99"])
    return q.select("median", "q1", "q3", F.greatest(F.col("p1"), F.lit(0.0)).alias("p1"), "p99")


# --------------------------------------------------------------------------- A29
def dataset_averages(df: DataFrame, experience: str, skills_count: str) -> DataFrame:
    return df.agg(F.avg(experience).alias("mean_experience"),
                  F.avg(skills_count).alias("mean_skills"))


# --------------------------------------------------------------------------- A31
def multiplier_class(df: DataFrame, city: str = "location", value: str = "salary_mid",
                     k: int = 10) -> DataFrame:
    """Top k cities by median with their multiplier (default 1.0) and a 3-level class."""
    top = city_stats(df, city, value).orderBy(F.col("median").desc(), F.col(city)).limit(k)
    mult = group_multiplier(df, city, value).select(city, "multiplier")
    m = F.coalesce(F.col("multiplier"), F.lit(1.0))
    return top.join(mult, city, "left").select(
        city, "median", m.alias("multiplier"),
        F.when(m >= 1.1, "high").when(m >= 1.0, "neutral").otherwise("low").alias("class"))


# --------------------------------------------------------------------------- T3
def top_n_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """n-largest rows per group. Spark plans a WindowGroupLimit below the window,
    so only n rows per group and partition reach the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# --------------------------------------------------------------------------- T4
def dedup_keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keep the first row of each key by ``order`` (numeric or date columns). The first order
    values are a hash aggregate of a narrow table, so a key holding a third of the rows is
    reduced map-side; the rows are picked by a semi join on key and order, which spreads a
    hot key by its order values. Rows that agree in key and order count as one."""
    narrow = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    if len(order) == 1:
        first = narrow.groupBy("_key").agg(F.min("_o0").alias("_o0"))
    else:
        first = narrow.groupBy("_key").agg(F.min(F.struct(*[f"_o{i}" for i in range(len(order))])).alias("_r")).select("_key", "_r.*")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)],
                F.col(key).eqNullSafe(F.col("_key")))
    return df.join(first, on, "left_semi").dropDuplicates([key, *order])


# --------------------------------------------------------------------------- T5
def restrict_to(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")
