"""Score, warning and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import risk, scoring
from orrery.plans import views as v
from orrery.plans.news_queries import articles
from orrery.plans.registry import query

SOURCES = {"src0": (1, 0.95, 120), "src1": (2, 0.85, 30), "src2": (3, 0.7, 12), "src3": (4, 0.6, 3)}
AUTHOR = "CASE doc_id % 4 WHEN 1 THEN 'Staff Reporter' WHEN 2 THEN 'Chief Equity Analyst' WHEN 3 THEN 'J. Doe' END"


@query(f"""WITH d AS (SELECT *, {AUTHOR} AS author FROM documents) SELECT doc_id AS article_id, round(0.4e0 * CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 0.8e0 WHEN 'src2' THEN 0.7e0 WHEN 'src3' THEN 0.5e0 ELSE 0.4e0 END
 + 0.2e0 * CASE source WHEN 'src0' THEN 0.95e0 WHEN 'src1' THEN 0.85e0 WHEN 'src2' THEN 0.7e0 WHEN 'src3' THEN 0.6e0 ELSE 0.5e0 END + 0.15e0 * CASE doc_id % 4 WHEN 0 THEN 0.3e0 WHEN 1 THEN 0.7e0 WHEN 2 THEN 0.8e0 ELSE 0.5e0 END
 + 0.15e0 * CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 0.8e0 WHEN 'src2' THEN 0.7e0 ELSE 0.5e0 END
 + 0.1e0 * least(1, 0.5e0 + CASE source WHEN 'src0' THEN 0.3e0 WHEN 'src1' THEN 0.2e0 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'methodology|how we calculated|data source:|source:') THEN 0.1e0 ELSE 0 END), 3) AS credibility,
 round(least(1, CASE WHEN n_chars >= 2000 THEN 0.3e0 WHEN n_chars >= 1000 THEN 0.2e0 WHEN n_chars >= 300 THEN 0.1e0 ELSE 0 END + least(0.05e0 * (doc_id % 9), 0.3e0) + least(0.1e0 * (doc_id % 3), 0.2e0)), 6) AS importance,
 round(least(1, 0.4e0 + 0.2e0 * abs((doc_id % 21 - 10) / 10e0) + CASE WHEN doc_id % 4 = 0 THEN 0.15e0 ELSE 0 END + CASE WHEN doc_id % 3 > 0 THEN 0.1e0 ELSE 0 END), 6) AS impact FROM d""")
def article_scores(spark, sf):
    d = v.table(spark, sf, "documents")
    i = F.col("doc_id")
    return v.rounded(d.select(i.alias("article_id"), scoring.credibility(F.col("source"), F.expr(AUTHOR), F.col("text"), SOURCES).alias("credibility"), scoring.importance(F.col("n_chars"), i % 9, i % 3).alias("importance"), scoring.market_impact(F.lit(0.4), (i % 21 - 10) / 10.0, i % 4 == 0, i % 3).alias("impact")))


@query("""WITH s AS (SELECT event_type, avg(value / 500) AS m, count(*) AS n FROM events GROUP BY 1) SELECT event_type, round(greatest(0.01, least(0.99, 0.1e0 + 0.9e0 * m * 0.5e0)), 6) AS probability, round(0.3e0 + 0.4e0 * m + 0.3e0 * least(1, n / 5e0), 6) AS confidence FROM s""")
def event_probability(spark, sf):
    s = v.table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.col("value") / 500).alias("m"), F.count(F.lit(1)).alias("n"))
    p, c = scoring.event_probability(F.lit(0.1), F.col("m"), F.col("n"))
    return v.rounded(s.select("event_type", p.alias("probability"), c.alias("confidence")))


@query("""WITH g AS (SELECT lang, avg(0.4e0 * (doc_id % 10) / 10e0 + 0.4e0 * (doc_id % 7) / 7e0 + 0.2e0 * least(n_chars / 500e0, 1)) AS quality, count(*) AS n, count(DISTINCT doc_id % 5) AS kinds, count(DISTINCT source) AS sources FROM documents GROUP BY 1)
SELECT lang, round(quality, 6) AS quality, n, kinds, sources, round(0.5e0 * least(ln(n + 1) / ln(20), 1) + 0.3e0 * least(kinds / 8e0, 1) + 0.2e0 * least(sources / 10e0, 1), 6) AS quantity FROM g""")
def evidence_quality(spark, sf):
    d = v.table(spark, sf, "documents")
    e = d.select("lang", ((F.col("doc_id") % 10) / 10.0).alias("relevance"), ((F.col("doc_id") % 7) / 7.0).alias("confidence"), F.col("n_chars").alias("length"), (F.col("doc_id") % 5).alias("kind"), "source")
    return v.rounded(scoring.evidence_quality(e, "lang"))


@query("""WITH g AS (SELECT user_id, sum(value / 500 * (event_id % 3 + 1)) / sum(event_id % 3 + 1) AS o, avg(value / 500) AS m, stddev_pop(value / 500) AS s, count(*) AS n FROM events GROUP BY 1) SELECT user_id, round(o, 6) AS overall, round(greatest(0, m - 1.96 * s / sqrt(n)), 6) AS low, round(least(1, m + 1.96 * s / sqrt(n)), 6) AS high FROM g""")
def confidence_intervals(spark, sf):
    d = v.table(spark, sf, "events").select("user_id", (F.col("value") / 500).alias("score"), (F.col("event_id") % 3 + 1).alias("weight"))
    return v.rounded(scoring.confidence_interval(d, "user_id", "score", "weight"))


@query(f"""WITH {v.RETURNS}, l AS (SELECT portfolio, day, sum(ln(1 + r)) OVER (PARTITION BY portfolio ORDER BY day) AS x FROM returns), t AS (SELECT *, max(x) OVER (PARTITION BY portfolio ORDER BY day) AS top FROM l) SELECT portfolio, round(arg_max(exp(x - top) - 1, day), 6) AS drawdown, arg_max(exp(x - top) - 1, day) < -0.1 AS triggered FROM t GROUP BY 1""")
def crash_warning(spark, sf):
    return v.rounded(scoring.crash_warning(risk.simple_returns(v.snapshots(spark, sf))))


@query(f"""WITH {v.RETURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY day DESC) AS k FROM returns), g AS (SELECT portfolio, stddev_pop(r) FILTER (k <= 10) / nullif(stddev_pop(r) FILTER (k > 10), 0) AS ratio FROM k WHERE k <= 252 GROUP BY 1) SELECT portfolio, round(ratio, 6) AS ratio, ratio > 1.5 AS triggered FROM g""")
def volatility_warning(spark, sf):
    return v.rounded(scoring.volatility_warning(risk.simple_returns(v.snapshots(spark, sf))))


@query(f"""WITH {v.RETURNS}, c AS (SELECT x.portfolio AS a, y.portfolio AS b, corr(x.r, y.r) FILTER (x.day >= DATE '1999-01-01') AS now, corr(x.r, y.r) FILTER (x.day < DATE '1999-01-01') AS was FROM returns x JOIN returns y ON x.day = y.day AND x.portfolio < y.portfolio GROUP BY 1, 2) SELECT round(avg(abs(now - was)), 6) AS change, avg(abs(now - was)) > 0.3 AS triggered FROM c""")
def correlation_breakdown(spark, sf):
    r = risk.simple_returns(v.snapshots(spark, sf))
    c = lambda d: risk.pairwise_correlation(d).select("a", "b", "correlation")
    return v.rounded(scoring.correlation_breakdown(c(r.where("day >= date'1999-01-01'")), c(r.where("day < date'1999-01-01'"))))


@query(f"""WITH {v.SNAPSHOTS}, p AS (SELECT portfolio, value AS actual, lag(value) OVER o AS before, avg(value) OVER (PARTITION BY portfolio ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS predicted FROM snapshots WINDOW o AS (PARTITION BY portfolio ORDER BY day))
SELECT portfolio, round(avg(abs(actual - predicted)), 4) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 4) AS rmse, round(avg(abs((actual - predicted) / actual)), 6) AS mape, round(avg(CAST(sign(actual - before) = sign(predicted - before) AS DOUBLE)), 6) AS hit_rate FROM p WHERE before IS NOT NULL GROUP BY 1""")
def forecast_backtest(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("portfolio").orderBy("day")
    d = v.snapshots(spark, sf).select("portfolio", F.col("value").alias("actual"), F.lag("value").over(w).alias("before"), F.avg("value").over(w.rowsBetween(-3, -1)).alias("predicted")).where("before is not null")
    e = scoring.forecast_errors(d, "portfolio", "actual", "predicted", "before")
    return e.select("portfolio", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("mape", 6).alias("mape"), F.round("hit_rate", 6).alias("hit_rate"))


@query("""WITH p AS (SELECT * FROM (VALUES ('small', 0.1e0, 0.4e0), ('large', 2e0, 8e0)) t(model, a, b)), c AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model, event_id % 900 AS x, event_id % 70 AS y FROM events) SELECT event_id, c.model, round(x / 1000e0 * coalesce(a, 0) + y / 1000e0 * coalesce(b, 0), 6) AS cost FROM c LEFT JOIN p USING (model)""")
def call_costs(spark, sf):
    prices = spark.createDataFrame([("small", 0.1, 0.4), ("large", 2.0, 8.0)], "model string, prompt double, completion double")
    i = F.col("event_id")
    c = v.table(spark, sf, "events").select("event_id", F.when(i % 3 == 0, "small").when(i % 3 == 1, "large").otherwise("other").alias("model"), (i % 900).alias("prompt_tokens"), (i % 70).alias("completion_tokens"))
    return v.rounded(scoring.call_cost(c, prices).select("event_id", "model", "cost"))


@query("""WITH s AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' ELSE 'interval' END AS k FROM events) SELECT event_id, CAST(CASE k WHEN 'hourly' THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 'daily' THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 'weekly' THEN date_trunc('week', ts) + INTERVAL 7 DAY WHEN 'monthly' THEN date_trunc('month', ts) + INTERVAL 1 MONTH ELSE date_trunc('second', ts) + INTERVAL 15 MINUTE END AS VARCHAR) AS next_run FROM s""")
def schedule_next_run(spark, sf):
    i = F.col("event_id")
    kind = F.when(i % 5 == 0, "hourly").when(i % 5 == 1, "daily").when(i % 5 == 2, "weekly").when(i % 5 == 3, "monthly").otherwise("interval")
    ts = F.date_trunc("second", F.col("ts"))
    n = scoring.next_run(kind, ts, F.lit(15))
    return v.table(spark, sf, "events").select("event_id", F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("""WITH t AS (SELECT *, lead(text) OVER o AS answer, lead(role) OVER o AS nr FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sha256(text) AS question, sha256(answer) AS answer FROM t WHERE role = 'user' AND nr = 'assistant' AND (contains(text, '?') OR regexp_matches(lower(text), '^(what|how|why|when|where|who|which|can|could|is|are|do|does)\\b'))""")
def transcript_questions(spark, sf):
    d = scoring.question_answers(v.table(spark, sf, "conversations"))
    return d.select("conv_id", "turn", F.sha2("question", 256).alias("question"), F.sha2("answer", 256).alias("answer"))


@query("""SELECT user_id % 40 AS proposal, count(*) FILTER (event_id % 10 > 8) AS high, count(*) FILTER (event_id % 10 BETWEEN 5 AND 8) AS medium, count(*) FILTER (event_id % 10 < 5) AS low, count(*) FILTER (event_type = 'error' AND event_id % 10 > 5) AS dissent FROM events GROUP BY 1""")
def dissent_histogram(spark, sf):
    e = v.table(spark, sf, "events").select((F.col("user_id") % 40).alias("proposal"), F.col("event_type").alias("option"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return scoring.opinion_shares(e, "proposal")


@query("""SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang) HAVING source IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT source, '-', count(*) FROM documents GROUP BY 1 UNION ALL SELECT '-', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT '-', '-', count(*) FROM documents""")
def coverage_cube(spark, sf):
    d = articles(spark, sf).cube("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang"), "n")
