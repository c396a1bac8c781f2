"""Profile-versus-market queries, all batch.

A profile table has one row per ``profile_id`` with the offer columns
(job, city, sector, experience, skill flags, salary). Nothing loops over
profiles: each operator is joins and aggregates over both tables.

Where a profile must meet every offer (K1 employability, K2 similarity), the
offers are first collapsed to the keys the score depends on (skill mask; or
sector, city, experience, stack size with the five smallest ids). Those key
tables are bounded by the vocabularies, not by the row count, so the
profile x key pairing stays the same size when the offers grow 1000x.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.operators.quantiles import count_below, exact_quantiles, number_bucket
from offerlake.session import materialize

ERROR_P75 = 7417.0  # fixed value: P75 absolute error of the reference model (EUR)


def skill_mask(df: DataFrame, skill_cols: list[str]) -> Column:
    """Pack 0/1 skill columns into an int bit mask (bit i = skill i)."""
    return reduce(lambda a, b: a.bitwiseOR(b), [
        F.shiftleft(F.coalesce(F.col(c).cast("int"), F.lit(0)), i) for i, c in enumerate(skill_cols)])


def representative_profiles(offers: DataFrame, cols, keys: list[str]) -> DataFrame:
    """One profile per cell of ``keys``: the offer with the smallest id. The smallest ids are
    a hash aggregate (a hot cell is reduced map-side); the offers are then picked by a
    semi join with that small table."""
    other = [c for c in offers.columns if c not in keys and c != cols.id]
    first = offers.groupBy(*keys).agg(F.min(cols.id).alias("_first")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return (offers.join(first, reduce(lambda a, b: a & b, on, F.col(cols.id) == F.col("_first")), "left_semi")
            .withColumnRenamed(cols.id, "profile_id").select("profile_id", *keys, *other))


# --------------------------------------------------------------------- K1
def employability(profiles: DataFrame, offers: DataFrame, skill_cols: list[str],
                  threshold: float = 0.7) -> DataFrame:
    """Share of offers whose required skills the profile covers at >= threshold
    (match = |owned & required| / |required|, 1.0 when nothing is required)."""
    om = offers.select(skill_mask(offers, skill_cols).alias("om")).groupBy("om").count()
    total = offers.select(F.count(F.lit(1))).scalar()
    pm = profiles.select("profile_id", skill_mask(profiles, skill_cols).alias("pm"))
    masks = pm.select("pm").distinct()
    # both sides have at most 2^len(skill_cols) rows: a bounded pairing
    req = F.bit_count(F.col("om"))
    match = F.when(req == 0, F.lit(1.0)).otherwise(F.bit_count(F.col("pm").bitwiseAND(F.col("om"))) / req)
    per_mask = (masks.crossJoin(F.broadcast(om))
                .groupBy("pm").agg(F.sum(F.when(match >= threshold, F.col("count")).otherwise(0)).alias("hits")))
    return pm.join(per_mask, "pm").select("profile_id", (F.col("hits") / total).alias("employability"))


# --------------------------------------------------------------------- K2, T3, A28
SAME_SECTOR, SAME_CITY, EXP_W, STACK_W = 1.0, 0.8, 0.3, 0.2   # fixed values: similarity weights


def similar_offers(profiles: DataFrame, offers: DataFrame, cols, stack_cols: list[str],
                   k: int = 5) -> DataFrame:
    """Top-k offers by -0.3|d exp| - 0.2|d stack| + 1.0 same sector + 0.8 same city;
    ties broken by offer id. Offers with unknown experience never score.

    Exact with equi-joins only:
    1. offers collapse to (sector, city, exp, stack) cells keeping the k smallest
       ids (WindowGroupLimit trims each cell map-side; a hot cell never travels
       whole); profiles collapse to distinct keys (same key, same answer);
    2. cells of the profile's own (sector, city) - bonus 1.8 - give each key its
       k-th best score T (equi-join on sector, city);
    3. any other offer scores at most 1.0 - 0.3|d exp|, so it can only reach T
       when |d exp| <= (1.0 - T) / 0.3: a band join on integer experience
       buckets within that radius (the whole experience range only for keys
       whose own cell holds fewer than k offers);
    4. union, rank, keep k, join back to the profiles."""
    stack = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in stack_cols])
    o = offers.where(F.col(cols.experience).isNotNull()).select(
        F.col(cols.id).alias("offer_id"), F.col(cols.sector).alias("o_sector"),
        F.col(cols.city).alias("o_city"), F.col(cols.experience).alias("o_exp"), stack.alias("o_stack"),
        F.col(cols.salary).alias("o_salary"))
    w = Window.partitionBy("o_sector", "o_city", "o_exp", "o_stack").orderBy("offer_id")
    # used four times below and bounded by the vocabularies: checkpointed once
    cells = materialize(o.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
                        .withColumn("_bucket", F.floor("o_exp").cast("long")))
    p = profiles.where(F.col(cols.experience).isNotNull()).select(
        "profile_id", F.col(cols.sector).alias("p_sector"), F.col(cols.city).alias("p_city"),
        F.col(cols.experience).alias("p_exp"), stack.alias("p_stack"))
    key = ["p_sector", "p_city", "p_exp", "p_stack"]
    pkeys = p.select(*key).distinct()

    def score() -> Column:
        return (-F.abs(F.col("o_exp") - F.col("p_exp")) * EXP_W
                - F.abs(F.col("o_stack") - F.col("p_stack")) * STACK_W
                + F.when(F.col("o_sector") == F.col("p_sector"), SAME_SECTOR).otherwise(0.0)
                + F.when(F.col("o_city") == F.col("p_city"), SAME_CITY).otherwise(0.0))

    def top(df: DataFrame) -> DataFrame:
        wk = Window.partitionBy(*key).orderBy(F.col("similarity").desc(), F.col("offer_id"))
        return df.withColumn("rank", F.row_number().over(wk)).where(F.col("rank") <= k)

    own = top(pkeys.join(cells, (F.col("o_sector") == F.col("p_sector")) & (F.col("o_city") == F.col("p_city")))
              .withColumn("similarity", score()))
    kth = own.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("similarity").alias("_t"))
    lo_b = cells.select(F.min("_bucket")).scalar()
    hi_b = cells.select(F.max("_bucket")).scalar()
    radius = F.ceil((F.lit(SAME_SECTOR) - F.col("_t")) / EXP_W).cast("long")
    band = (pkeys.join(kth, key, "left")
            .withColumn("_full", F.coalesce(F.col("_n"), F.lit(0)) < k)
            # nothing outside the own cell scores above the sector bonus
            .where(F.col("_full") | (F.col("_t") <= SAME_SECTOR))
            .withColumn("_pb", F.floor("p_exp").cast("long"))
            .withColumn("_bucket", F.explode(F.sequence(
                F.when(F.col("_full"), lo_b).otherwise(F.greatest(F.col("_pb") - radius - 1, lo_b)),
                F.when(F.col("_full"), hi_b).otherwise(F.least(F.col("_pb") + radius + 1, hi_b))))))
    others = (band.join(cells, "_bucket")
              .where(~((F.col("o_sector") == F.col("p_sector")) & (F.col("o_city") == F.col("p_city"))))
              .withColumn("similarity", score())
              .where(F.col("_full") | (F.col("similarity") >= F.col("_t"))))
    cand = own.drop("rank").select(*key, "offer_id", "similarity", "o_salary").unionByName(
        others.select(*key, "offer_id", "similarity", "o_salary"))
    return (p.join(top(cand), key)
            .select("profile_id", "rank", "offer_id", "similarity", "o_salary"))


def similar_summary(similar: DataFrame, profiles: DataFrame, salary: str) -> DataFrame:
    """Mean salary of the matches and share of matches paid below the profile."""
    j = similar.join(profiles.select("profile_id", F.col(salary).alias("p_salary")), "profile_id")
    return j.groupBy("profile_id").agg(
        F.avg("o_salary").alias("mean_match_salary"),
        F.avg((F.col("o_salary") < F.col("p_salary")).cast("double")).alias("share_below"),
        F.count(F.lit(1)).alias("n_matches"))


# --------------------------------------------------------------------- K3, K4
def percentile_rank(profiles: DataFrame, value_col: str, market: DataFrame, market_col: str) -> DataFrame:
    """100 x share of market values strictly below the profile's value (denominator:
    non-null market values), clipped to 0..100; empty market -> 50.

    Exact and distributed: see ``count_below``; no profile meets raw market rows."""
    pv = profiles.select("profile_id", F.col(value_col).cast("double").alias("v"))
    below = count_below(pv, market, market_col)
    total = market.select(F.count(market_col)).scalar()
    pct = (F.when(F.col("v").isNull(), F.lit(None).cast("double"))
           .when(F.coalesce(total, F.lit(0)) == 0, F.lit(50.0))
           .otherwise(F.least(F.greatest(F.col("below") * 100.0 / total, F.lit(0.0)), F.lit(100.0))))
    return pv.join(below, "v", "left").select("profile_id", pct.alias("percentile"))


def position_label(pct: Column) -> Column:
    """K4, five levels."""
    return (F.when(pct >= 90, "Top 10%").when(pct >= 75, "Top 25%").when(pct >= 50, "Above median")
            .when(pct >= 25, "Below median").otherwise("Bottom 25%"))


def position_verdict(pct: Column) -> Column:
    """K4, three levels: the reading shown with an estimate."""
    return F.when(pct >= 75, "excellent").when(pct >= 50, "above average").otherwise("below median")


# --------------------------------------------------------------------- J4, K5
def peer_median(profiles: DataFrame, offers: DataFrame, cols, tolerance: float = 1.0) -> DataFrame:
    """Median salary of offers with the same job, city and sector and experience
    within +/- tolerance. Computed once per distinct profile key (job, city,
    sector, experience) - profiles sharing a key share the answer - by a band
    join: each key is copied to the integer experience buckets its range touches (3 for a
    tolerance of 1) while every offer travels once, then an equi-join on (job, city,
    sector, bucket) and the exact range test."""
    keys = ["_job", "_city", "_sector", "_pexp"]
    o = offers.where(F.col(cols.salary).isNotNull() & F.col(cols.experience).isNotNull()).select(
        F.col(cols.job).alias("_job"), F.col(cols.city).alias("_city"), F.col(cols.sector).alias("_sector"),
        F.col(cols.experience).alias("_oexp"), F.col(cols.salary).alias("_sal"),
        F.floor(F.col(cols.experience)).cast("int").alias("_b"))
    p = profiles.where(F.col(cols.experience).isNotNull()).select(
        "profile_id", F.col(cols.job).alias("_job"), F.col(cols.city).alias("_city"),
        F.col(cols.sector).alias("_sector"), F.col(cols.experience).alias("_pexp"))
    pk = p.select(*keys).distinct().withColumn("_b", F.explode(F.sequence(
        F.floor(F.col("_pexp") - tolerance).cast("int"), F.floor(F.col("_pexp") + tolerance).cast("int"))))
    peers = pk.join(o, ["_job", "_city", "_sector", "_b"]).where(
        F.abs(F.col("_oexp") - F.col("_pexp")) <= tolerance)
    med = exact_quantiles(peers, "_sal", [0.5], keys, ["peer_median"]).withColumnRenamed("_count", "n_peers")
    return p.join(med, keys).select("profile_id", "peer_median", "n_peers")


def profile_estimate(profiles: DataFrame, offers: DataFrame, cols, scorer, min_peers: int = 3) -> DataFrame:
    """K5: peer median (+1000 per skill) when >= min_peers peers, else the rule scorer."""
    peers = peer_median(profiles, offers, cols)
    scored = scorer(profiles)
    bonus = scorer.skill_bonus * scorer.skills_count(profiles)
    return (scored.join(peers, "profile_id", "left").select(
        "profile_id", F.coalesce(F.col("n_peers"), F.lit(0)).alias("n_peers"),
        F.when(F.col("n_peers") >= min_peers, F.col("peer_median") + bonus)
        .otherwise(F.col("prediction")).alias("estimate")))


# --------------------------------------------------------------------- K6
def pair_compare(estimates: DataFrame, profiles: DataFrame, cols, order_within: str) -> DataFrame:
    """Pairs each profile with the next profile (by id) of the same ``order_within``
    value; difference, 'equivalent' below 2000. A value that most profiles share is spread
    over buckets of the id: inside a bucket the next row follows, and the last row of a bucket
    gets the first of the next one from a table of bucket heads."""
    j = (profiles.select("profile_id", F.col(order_within).alias("_g")).join(estimates, "profile_id")
         .select("profile_id", "_g", "estimate", number_bucket(F.col("profile_id").cast("double")).alias("_b")))
    w = Window.partitionBy("_g", "_b").orderBy("profile_id")
    heads = j.groupBy("_g", "_b").agg(F.min("profile_id").alias("_id"), F.min_by("estimate", "profile_id").alias("_e"))
    across = Window.partitionBy("_g").orderBy("_b")
    following = heads.select(F.col("_g").alias("_hg"), F.col("_b").alias("_hb"), F.lead("_id").over(across).alias("_next"),
                             F.lead("_e").over(across).alias("_next_e"))
    inside = j.withColumns({"_lead": F.lead("profile_id").over(w), "_lead_e": F.lead("estimate").over(w)})
    pairs = inside.join(following, F.col("_g").eqNullSafe(F.col("_hg")) & (F.col("_b") == F.col("_hb"))).select(
        F.col("profile_id").alias("profile_a"), F.col("estimate").alias("salary_a"), F.coalesce("_lead", "_next").alias("profile_b"),
        F.when(F.col("_lead").isNotNull(), F.col("_lead_e")).otherwise(F.col("_next_e")).alias("salary_b")).where(
        F.col("profile_b").isNotNull())
    diff = F.col("salary_b") - F.col("salary_a")
    return pairs.select("profile_a", "profile_b", "salary_a", "salary_b", diff.alias("difference"),
                        F.when(F.abs(diff) < 2000, "equivalent").when(diff > 0, "b_higher")
                        .otherwise("a_higher").alias("verdict"))


# --------------------------------------------------------------------- A24, K7
def peer_band(profiles: DataFrame, offers: DataFrame, cols, min_peers: int = 5) -> DataFrame:
    """P8 peers (same job and city): median of salary_min / salary_max and median
    salary; profiles with fewer than min_peers peers get no band. Without salary_min and
    salary_max columns the band is 0.9 and 1.1 times the median salary. Computed per
    (job, city) cell in one quantile pass over (cell, measure), then joined to profiles."""
    keys = [cols.job, cols.city]
    ranges = cols.salary_min in offers.columns and cols.salary_max in offers.columns
    measures = [("band_median", cols.salary)] + ([("band_min", cols.salary_min), ("band_max", cols.salary_max)] if ranges else [])
    long = offers.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(c).cast("double").alias("v")) for n, c in measures])).alias("_m")).select(*keys, "_m.*")
    med = exact_quantiles(long, "v", [0.5], [*keys, "measure"], ["m"])
    wide = med.groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == n, F.col("m"))).alias(n) for n, _ in measures])
    if not ranges:
        wide = wide.withColumns({"band_min": F.col("band_median") * 0.9, "band_max": F.col("band_median") * 1.1})
    n = offers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_peers"))
    cell = n.join(wide, keys, "left").where(F.col("n_peers") >= min_peers)
    return profiles.select("profile_id", *keys).join(cell, keys).select(
        "profile_id", "n_peers", "band_min", "band_max", "band_median")


def negotiation_band(estimates: DataFrame, band: DataFrame, error: float = ERROR_P75) -> DataFrame:
    """K7: [max(pred - e, band_min), min(pred + e, band_max)] and the position."""
    j = estimates.join(band, "profile_id")
    lower = F.greatest(F.col("estimate") - error, F.col("band_min"))
    upper = F.least(F.col("estimate") + error, F.col("band_max"))
    return j.select("profile_id", lower.alias("lower"), F.col("estimate").alias("target"), upper.alias("upper"),
                    F.when(F.col("estimate") < F.col("band_min"), "below_market")
                    .when(F.col("estimate") > F.col("band_max"), "above_market")
                    .otherwise("in_market").alias("position"))


# --------------------------------------------------------------------- A25, J8, J9
def role_skill_demand(offers: DataFrame, cols, skills: list[tuple[str, str]], min_offers: int = 10) -> DataFrame:
    """Per role with >= min_offers offers: share of offers requiring each skill."""
    agg = offers.where(F.col(cols.job).isNotNull()).groupBy(cols.job).agg(
        F.count(F.lit(1)).alias("offer_count"),
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_r_{n}") for n, c in skills])
    return agg.where(F.col("offer_count") >= min_offers).select(
        F.col(cols.job).alias("role"), "offer_count",
        F.explode(F.array(*[F.struct(F.lit(n).alias("skill"), F.col(f"_r_{n}").alias("rate"))
                            for n, _ in skills])).alias("_s")).select("role", "offer_count", "_s.*")


def missing_skills(profiles: DataFrame, skills: list[tuple[str, str]]) -> DataFrame:
    """One row per (profile, skill not owned), by exploding the profile's own
    flags (no join with a skill table needed)."""
    arr = F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("int"), F.lit(0)) == 0, F.lit(n))
                             for n, c in skills]), lambda x: x.isNotNull())
    return profiles.select("profile_id", F.posexplode(arr).alias("skill_pos", "skill"))


def role_gap(profiles: DataFrame, offers: DataFrame, cols, skills: list[tuple[str, str]],
             min_rate: float = 0.3, min_offers: int = 10) -> DataFrame:
    """J9 + A25: for each profile and each other role with enough offers, the skills
    the profile lacks that more than ``min_rate`` of the role's offers require."""
    demand = role_skill_demand(offers, cols, skills, min_offers)
    # the roles (a vocabulary) become one array, attached to each profile by explode: no join
    roles = demand.select("role", "offer_count").distinct().agg(
        F.sort_array(F.collect_list(F.struct("role", "offer_count")))).scalar()
    pr = (profiles.select("profile_id", F.col(cols.job).alias("current_role"), roles.alias("_roles"))
          .select("profile_id", "current_role", F.explode("_roles").alias("_r"))
          .select("profile_id", "current_role", "_r.*").where(F.col("role") != F.col("current_role")).drop("current_role"))
    miss = missing_skills(profiles, skills)
    need = demand.where(F.col("rate") > min_rate).select("role", "skill", "rate")
    gaps = miss.join(need, "skill").select("profile_id", "role", "skill", "rate")
    return pr.join(gaps, ["profile_id", "role"], "left").select(
        "profile_id", "role", "offer_count", "skill", "rate")


# --------------------------------------------------------------------- J2, J3
DEFAULT_JOB_RANGE = (35000, 60000)     # fixed values: fallback ranges of the reference
DEFAULT_EXP_RANGE = (60000, 90000)


def profile_ranges(profiles: DataFrame, job_ranges: DataFrame, exp_ranges: DataFrame, cols,
                   last_bin: str = "12-30") -> DataFrame:
    """The profile's job P25/P75 (default 35000-60000). J3: the range of the
    left-closed experience bin holding the profile (bins with too few rows are
    absent); otherwise the last bin's range, else 60000-90000. The range tables
    are aggregates (one row per group value); AQE broadcasts them when small."""
    from offerlake.operators.market import experience_range_bin
    last = exp_ranges.where(F.col("exp_bin") == last_bin)
    last_lo = last.select(F.max("p25")).scalar()
    last_hi = last.select(F.max("p75")).scalar()
    j = (profiles.select("profile_id", F.col(cols.job).alias("_job"),
                         experience_range_bin(F.col(cols.experience)).alias("_bin"))
         .join(job_ranges.select(F.col(cols.job).alias("_job"), F.col("p25").alias("job_lo"),
                                 F.col("p75").alias("job_hi")), "_job", "left")
         .join(exp_ranges.select(F.col("exp_bin").alias("_bin"), F.col("p25").alias("exp_lo"),
                                 F.col("p75").alias("exp_hi")), "_bin", "left"))
    return j.select(
        "profile_id",
        F.coalesce("job_lo", F.lit(DEFAULT_JOB_RANGE[0]).cast("long")).alias("job_low"),
        F.coalesce("job_hi", F.lit(DEFAULT_JOB_RANGE[1]).cast("long")).alias("job_high"),
        F.coalesce("exp_lo", last_lo, F.lit(DEFAULT_EXP_RANGE[0]).cast("long")).alias("exp_low"),
        F.coalesce("exp_hi", last_hi, F.lit(DEFAULT_EXP_RANGE[1]).cast("long")).alias("exp_high"))


# --------------------------------------------------------------------- K6 axes
def profile_axes(profiles: DataFrame, city_mult: DataFrame, sector_mult: DataFrame, cols,
                 skill_cols: list[str]) -> DataFrame:
    """K6 comparison axes on a 0-100 scale: experience / 15, city and sector
    multipliers (default 1.0), skills / 8. The multiplier tables are aggregates
    (one row per group value); AQE broadcasts them when small."""
    skills = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in skill_cols])
    cm = city_mult.select(F.col(cols.city).alias("_c"), F.col("multiplier").alias("_cm"))
    sm = sector_mult.select(F.col(cols.sector).alias("_s"), F.col("multiplier").alias("_sm"))
    j = (profiles.join(cm, F.col(cols.city) == F.col("_c"), "left")
         .join(sm, F.col(cols.sector) == F.col("_s"), "left"))
    return j.select("profile_id", (F.col(cols.experience) / 15 * 100).alias("axis_experience"),
                    (F.coalesce("_cm", F.lit(1.0)) * 100).alias("axis_city"),
                    (F.coalesce("_sm", F.lit(1.0)) * 100).alias("axis_sector"),
                    (skills / 8 * 100).alias("axis_skills"))
