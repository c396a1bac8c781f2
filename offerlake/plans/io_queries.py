"""Driver queries for sources/sinks (S1, S5-S11), nested reports and the
streaming collection job (S12, R1). Written data goes to a fresh folder under
the session's shared ``spark.checkpoint.dir`` and is read back."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from offerlake.operators import market as A
from offerlake.operators import model as M
from offerlake.operators import profiles as K
from offerlake.operators import scenarios as S
from offerlake.plans import profile_queries as PQ
from offerlake.plans.market_queries import offers
from offerlake.plans.model_queries import CATEGORICAL, NUMERIC, _train_test
from offerlake.plans.registry import finish, query, with_offers
from offerlake.sources import sinks as SK
from offerlake.sources.offers import OFFER_COLUMNS as C
from offerlake.session import materialize
from offerlake.sources.tables import read_table
from offerlake.streaming import collect as CO
from offerlake.streaming.dedup import collect_offers, offer_records, shared_scratch


def _r(x: str) -> str:
    return f"round({x}, 4)"


EXPORT_COLUMNS = ["offer_id", "job_type", "location", "sector", "contract", "salary_mid", "salary_min",
                  "salary_max", "experience", "company"]   # 'company' is absent: S6 keeps what exists


# --------------------------------------------------------------------- S1, S5, S6
@query("sink_roundtrip", with_offers(f"""
SELECT offer_id, job_type, location, sector, contract, {_r('salary_mid')} AS salary_mid,
       {_r('salary_min')} AS salary_min, {_r('salary_max')} AS salary_max, {_r('experience')} AS experience
FROM offers"""))
def q_sink_roundtrip(spark, sf_dir):
    base = shared_scratch(spark, "sink")
    out = SK.export_columns(offers(spark, sf_dir), EXPORT_COLUMNS)
    SK.write_table(out, f"{base}/parquet")
    SK.write_table(spark.read.parquet(f"{base}/parquet"), f"{base}/csv", fmt="csv")
    back = SK.read_csv_table(spark, f"{base}/csv", out.schema)
    return finish(back)


# --------------------------------------------------------------------- S9
@query("roadmap_export", PQ._sql(f"""
SELECT profile_id, skill, {_r('gain')} AS gain, {_r('frequency * 100')} AS frequency_pct, {_r('roi')} AS roi,
       {_r('rarity')} AS rarity FROM road""", PQ._DEMAND, PQ._MISS, PQ._ROAD))
def q_roadmap_export(spark, sf_dir):
    path = shared_scratch(spark, "roadmap")
    SK.write_table(SK.roadmap_export(PQ._roadmap(spark, sf_dir)), path, fmt="csv")
    schema = "profile_id long, skill string, gain double, frequency_pct double, roi double, rarity double"
    return finish(spark.read.schema(schema).option("header", "true").csv(path))


# --------------------------------------------------------------------- S7
def _report_sql() -> str:
    from offerlake.plans import market_queries as MQ
    stk = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS stack, median(salary_mid) AS median, count(*) AS n FROM offers WHERE {pred} "
        f"HAVING count(*) >= 5" for name, pred in MQ.stack_predicates_sql().items())
    return with_offers(f"""
SELECT 'multipliers' AS section, location AS item, 'multiplier' AS field,
       {_r('median(salary_mid) / (SELECT median(salary_mid) FROM offers WHERE salary_mid IS NOT NULL)')} AS value
FROM offers WHERE salary_mid IS NOT NULL AND location IN (SELECT location FROM offers WHERE {MQ._KPI_WHERE}) GROUP BY location
UNION ALL SELECT 'multipliers', sector, 'multiplier',
       {_r('median(salary_mid) / (SELECT median(salary_mid) FROM offers WHERE salary_mid IS NOT NULL)')}
FROM offers WHERE salary_mid IS NOT NULL AND sector IN (SELECT sector FROM offers WHERE {MQ._KPI_WHERE}) GROUP BY sector
UNION ALL SELECT 'skill_impacts', skill, 'impact', {_r('median_with - median_without')} FROM imp
  WHERE holders >= 5 AND median_with - median_without IS NOT NULL
UNION ALL SELECT 'stacks', stack, 'median', {_r('median')} FROM stk
UNION ALL SELECT 'stacks', stack, 'n', CAST(n AS DOUBLE) FROM stk
UNION ALL SELECT 'statistics', '', 'mean', {_r('avg(salary_mid)')} FROM offers
UNION ALL SELECT 'statistics', '', 'median', {_r('median(salary_mid)')} FROM offers
UNION ALL SELECT 'statistics', '', 'std', {_r('stddev_pop(salary_mid)')} FROM offers
UNION ALL SELECT 'statistics', '', 'q1', {_r('quantile_cont(salary_mid, 0.25)')} FROM offers
UNION ALL SELECT 'statistics', '', 'q3', {_r('quantile_cont(salary_mid, 0.75)')} FROM offers
UNION ALL SELECT 'statistics', '', 'iqr', {_r('quantile_cont(salary_mid, 0.75) - quantile_cont(salary_mid, 0.25)')} FROM offers
UNION ALL SELECT 'statistics', '', 'min', {_r('min(salary_mid)')} FROM offers
UNION ALL SELECT 'statistics', '', 'max', {_r('max(salary_mid)')} FROM offers
UNION ALL SELECT 'statistics', '', 'count', CAST(count(salary_mid) AS DOUBLE) FROM offers""",
                       extra=f"imp AS ({MQ._IMPACT_SQL}),\nstk AS ({stk})")


@query("market_report", _report_sql())
def q_market_report(spark, sf_dir):
    off = offers(spark, sf_dir)
    meta = off.agg(F.count(F.lit(1)).alias("n_offers"))
    # the one-row summary already holds scalar subqueries: checkpoint it before it is
    # nested as a scalar itself (nested scalar merging trips a Spark optimizer bug)
    # multipliers of the groups that the filtered offers hold (T5)
    from offerlake.plans import market_queries as MQ
    _, chosen = MQ.filtered_offers(spark, sf_dir)
    held = {g: chosen.where(F.col(g).isNotNull()).select(g).distinct() for g in (C.city, C.sector)}
    report = SK.market_report(meta, materialize(A.salary_summary(off, C.salary)),
                              {g: A.group_multiplier(off, g, C.salary).select(g, "multiplier") for g in (C.city, C.sector)},
                              A.skill_impact(off, list(C.skills), C.salary, 5),
                              A.stack_stats(off, C.skill, C.salary, 5), held)
    report = SK.write_json(report, f"{shared_scratch(spark, 'market-report')}/json")
    return finish(SK.flatten_report(report).where(~F.col("field").isin("group_median")))


# --------------------------------------------------------------------- S8
@query("career_plan", PQ._sql("""
SELECT profile_id, 'top_skill' AS section, skill AS item, round(roi, 4) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY roi DESC, skill) AS k FROM road) WHERE k <= 3
UNION ALL
SELECT profile_id, 'transition', role, round(gain, 4) FROM (
  SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY gain DESC, role) AS k FROM trans) WHERE k <= 3
UNION ALL
SELECT profile_id, 'projection_year_4', strategy, round(prediction, 4) FROM (""" + PQ.rule_scorer_sql("proj") + """)
  WHERE year = 4
UNION ALL SELECT profile_id, 'missing_skill', skill, CAST(skill_pos AS DOUBLE) FROM miss
UNION ALL SELECT p.profile_id, 'owned_skill', sk.skill, 1.0 FROM profiles p, (VALUES """ + PQ._SKILL_VALUES + """) sk(skill, col, idx)
  WHERE """ + PQ._FLAG_OF.format(t="p") + """ = 1
UNION ALL SELECT profile_id, 'estimate', 'salary', round(base_prediction, 4) FROM base
UNION ALL SELECT profile_id, 'estimate', 'gap_to_median', round(base_prediction - (SELECT median(salary_mid) FROM offers), 4) FROM base
UNION ALL SELECT profile_id, 'estimate', 'percentile', round(100.0 * (SELECT count(*) FROM offers o WHERE o.salary_mid < base_prediction)
  / (SELECT count(salary_mid) FROM offers), 4) FROM base""", PQ._DEMAND, PQ._MISS, PQ._ROAD, PQ._GAPS, PQ._TRANS, PQ._PROJ))
def q_career_plan(spark, sf_dir):
    off, prof, scorer = PQ.setup(spark, sf_dir)
    road = S.skill_roadmap(prof, off, scorer, PQ.SKILLS)
    top_skills = A.top_n_per_group(road, ["profile_id"], [F.col("roi").desc(), F.col("skill")], 3)
    trans = S.role_transitions(prof, K.role_gap(prof, off, C, PQ.SKILLS), scorer, C)
    proj = S.projection(prof, scorer, C, PQ.SKILLS).where(F.col("year") == 4)
    base = scorer(prof).select("profile_id", "prediction")
    median = A.median_by(off, C.salary).select("median").scalar()
    est = base.join(K.percentile_rank(base, "prediction", off, C.salary), "profile_id").select("profile_id", F.explode(F.array(
        F.struct(F.lit("salary").alias("item"), F.col("prediction").alias("value")),
        F.struct(F.lit("gap_to_median").alias("item"), (F.col("prediction") - median).alias("value")),
        F.struct(F.lit("percentile").alias("item"), F.col("percentile").alias("value")))).alias("e")).select("profile_id", "e.*")
    owned = prof.select("profile_id", F.explode(F.filter(F.array(*[
        F.when(F.col(c) == 1, F.lit(n)) for n, c in PQ.SKILLS]), lambda x: x.isNotNull())).alias("item")).withColumn("value", F.lit(1.0))
    miss = K.missing_skills(prof, PQ.SKILLS).select("profile_id", F.col("skill").alias("item"), F.col("skill_pos").cast("double").alias("value"))
    doc = SK.per_profile_document(prof.select("profile_id"), {
        "top_skill": top_skills.select("profile_id", F.col("skill").alias("item"), F.col("roi").alias("value")),
        "transition": trans.select("profile_id", F.col("role").alias("item"), F.col("gain").alias("value")),
        "projection_year_4": proj.select("profile_id", F.col("strategy").alias("item"), F.col("prediction").alias("value")),
        "owned_skill": owned, "missing_skill": miss, "estimate": est})
    doc = SK.write_json(doc, f"{shared_scratch(spark, 'career-plan')}/json")
    sections = [c for c in doc.columns if c != "profile_id"]
    flat = doc.select("profile_id", F.explode(F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).alias("rows")) for c in sections])).alias("s"))
    return finish(flat.select("profile_id", "s.section", F.explode("s.rows").alias("e")).select("profile_id", "section", "e.item", "e.value"))


# --------------------------------------------------------------------- S10
@query("prediction_report", PQ._sql(f"""
SELECT s.profile_id, {_r('s.prediction')} AS prediction,
       {_r('100.0 * (SELECT count(*) FROM offers o WHERE o.salary_mid < s.prediction) / (SELECT count(salary_mid) FROM offers)')} AS market_percentile,
       {_r('(SELECT median(salary_mid) FROM offers)')} AS market_median,
       {_r('(SELECT quantile_cont(salary_mid, 0.25) FROM offers)')} AS market_q1,
       {_r('(SELECT quantile_cont(salary_mid, 0.75) FROM offers)')} AS market_q3,
       (SELECT count(*) FROM offers) AS dataset_rows, s.job_type, s.location, s.sector, {_r('s.experience')} AS experience,
       {_r('(SELECT avg(experience) FROM offers)')} AS mean_experience, {_r(f'(SELECT avg({PQ.STACK_SQL}) FROM offers)')} AS mean_skills
FROM scored s""", f"scored AS ({PQ.rule_scorer_sql('profiles')})"))
def q_prediction_report(spark, sf_dir):
    off, prof, scorer = PQ.setup(spark, sf_dir)
    pred = scorer(prof).select("profile_id", "prediction", C.job, C.city, C.sector, C.experience)
    pct = K.percentile_rank(pred, "prediction", off, C.salary)
    mq = A.market_quantiles(off, C.salary)
    skills = reduce(lambda a, b: a + b, [F.col(c) for c in C.skill_cols])
    doc = pred.join(pct, "profile_id").select(
        "profile_id", "prediction", F.struct(C.job, C.city, C.sector, C.experience).alias("profile"),
        F.col("percentile").alias("market_percentile"),
        mq.select("median").scalar().alias("market_median"), mq.select("q1").scalar().alias("market_q1"),
        mq.select("q3").scalar().alias("market_q3"), off.select(F.count(F.lit(1))).scalar().alias("dataset_rows"),
        off.select(F.avg(C.experience)).scalar().alias("mean_experience"), off.select(F.avg(skills)).scalar().alias("mean_skills"))
    doc = SK.write_json(doc, f"{shared_scratch(spark, 'prediction-report')}/json")
    return finish(doc.select(*[c for c in doc.columns if c != "profile"], "profile.*"))


# --------------------------------------------------------------------- S11
@query("model_persistence")
def q_model_persistence(spark, sf_dir):
    """Persist the split and a fitted pipeline, write a JSON report, load the
    model back and score the test rows with it."""
    base = shared_scratch(spark, "model")
    train, test = _train_test(spark, sf_dir)
    model = M.fit_pipeline(train, NUMERIC, CATEGORICAL, "linear", {"regParam": 0.1})
    SK.write_table(train, f"{base}/split/train")
    SK.write_table(test, f"{base}/split/test")
    model.write().overwrite().save(f"{base}/model")
    loaded = PipelineModel.load(f"{base}/model")
    scored = loaded.transform(spark.read.parquet(f"{base}/split/test"))
    metrics = M.regression_metrics(scored)
    report = metrics.select(F.lit("linear").alias("model"), F.struct("mae", "rmse", "r2", "n").alias("test"),
                            F.lit(json.dumps({"numeric": NUMERIC, "categorical": CATEGORICAL})).alias("features"))
    SK.write_table(report.coalesce(1), f"{base}/report", fmt="json")
    return scored.select(C.id, "label", "prediction")


# --------------------------------------------------------------------- S12, R1
@query("stream_dedup", """
SELECT DISTINCT md5(concat_ws('_', coalesce(text, ''), coalesce(source, ''), coalesce(lang, ''))) AS fingerprint,
       source, lang FROM documents WHERE length(text) > 5""")
def q_stream_dedup(spark, sf_dir):
    out = collect_offers(spark, sf_dir, "documents", offer_records, "fingerprint")
    return out.select("fingerprint", "source", "lang")


#: Turns that the collected documents come in, and events' days to a turn.
TURNS, EVENT_DAYS = 6, 5
_FOUND = f"""found AS (SELECT md5(concat_ws('_', coalesce(text, ''), coalesce(source, ''), coalesce(lang, ''))) AS fingerprint,
  source, lang, doc_id % {TURNS} AS turn FROM documents WHERE length(text) > 5),
goal AS (SELECT CAST(count(*) // 2 AS BIGINT) AS target FROM documents),
firsts AS (SELECT fingerprint, source, lang, min(turn) AS turn FROM found GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (ORDER BY turn, fingerprint) AS n FROM firsts)"""


def _collected(spark, sf_dir):
    """Documents as they come in, turn by turn, collected until half as many as there are documents."""
    docs = read_table(spark, sf_dir, "documents")
    base = shared_scratch(spark, "collect")
    rows = offer_records(docs).select("doc_id", "source", "lang", "fingerprint")
    files = CO.write_in_turn(rows.withColumn("turn", F.col("doc_id") % TURNS), "turn", f"{base}/incoming")
    stream = CO.read_files(spark, f"{base}/incoming", rows.schema, files)
    return CO.collect_to_target(stream, CO.Collected(f"{base}/out"), "fingerprint", "source", docs.count() // 2, snapshot_every=100)


@query("collect_to_target", f"WITH {_FOUND} SELECT fingerprint, source, lang, n FROM numbered WHERE n <= (SELECT target FROM goal)")
def q_collect_to_target(spark, sf_dir):
    """The collection loop with its seen-set, running number and target."""
    return CO.collected_rows(spark, _collected(spark, sf_dir)).select("fingerprint", "source", "lang", F.col("n").cast("long").alias("n"))


@query("collect_counters", f"""WITH {_FOUND},
last AS (SELECT coalesce(min(turn), {TURNS}) AS turn FROM numbered WHERE n >= (SELECT target FROM goal)),
seen AS (SELECT source, count(*) AS seen FROM found WHERE turn <= (SELECT turn FROM last) GROUP BY source),
new AS (SELECT source, count(*) AS fresh, count(*) FILTER (WHERE n <= (SELECT target FROM goal)) AS collected
        FROM numbered WHERE turn <= (SELECT turn FROM last) GROUP BY source)
SELECT source, seen, coalesce(collected, 0) AS collected, seen - coalesce(fresh, 0) AS duplicates
FROM seen LEFT JOIN new USING (source)""")
def q_collect_counters(spark, sf_dir):
    """A27 while collecting: rows seen, collected and met before, per source, when the target is reached."""
    return CO.counters(spark, _collected(spark, sf_dir), "source")


@query("stream_event_time", f"""
WITH e AS (SELECT *, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / {EVENT_DAYS}) AS BIGINT) AS turn FROM events),
d AS (SELECT * EXCLUDE (turn), turn + CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END AS turn FROM e
      UNION ALL SELECT * EXCLUDE (turn), turn + 1 FROM e WHERE event_id % 10 = 3),
tops AS (SELECT turn, max(ts) AS top FROM d GROUP BY turn),
marks AS (SELECT turn, max(top) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL {EVENT_DAYS} DAY AS mark FROM tops),
late AS (SELECT d.*, coalesce(ts <= date_trunc('millisecond', mark), FALSE) AS late FROM d JOIN marks USING (turn))
SELECT event_id, user_id, event_type, (SELECT count(*) FROM late WHERE late) AS late_rows
FROM (SELECT DISTINCT event_id, user_id, event_type FROM late WHERE NOT late)""")
def q_stream_event_time(spark, sf_dir):
    """R1 in event time: events come in files of five days, some again in the next file and some three
    files late (rows of a batch are held against the watermark that the batch before it started with)."""
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    turn = F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / EVENT_DAYS)
    sent = events.withColumn("turn", turn + F.when(F.col("event_id") % 50 == 0, 3).otherwise(0)).unionByName(
        events.where(F.col("event_id") % 10 == 3).withColumn("turn", turn + 1))
    base = shared_scratch(spark, "events")
    files = CO.write_in_turn(sent, "turn", f"{base}/incoming")
    stream = CO.read_files(spark, f"{base}/incoming", events.schema, files)
    kept, late = CO.dedup_events(stream, ["event_id"], "ts", f"{EVENT_DAYS} days", f"{base}/out")
    return kept.select("event_id", "user_id", "event_type", F.lit(late).cast("long").alias("late_rows"))
