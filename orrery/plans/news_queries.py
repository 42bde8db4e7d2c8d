"""News queries over documents and pages; the title of a document is its first line, its time counts hours by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import news
from orrery.plans import views as v
from orrery.plans.registry import query


def articles(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents")
    url = F.concat(F.lit("https://WWW."), F.col("source"), F.lit(".example.com/a/"), (F.col("doc_id") % 400).cast("string"), F.lit("/?utm_source=x&b="), (F.col("doc_id") % 3).cast("string"), F.lit("&a=1#top"))
    return d.select(F.col("doc_id").alias("article_id"), F.substring(F.split("text", "\n")[0], 1, 120).alias("title"), F.substring("text", 1, 300).alias("summary"), F.col("text").alias("content"), url.alias("url"), "source", "lang", (F.col("doc_id") % 900).cast("double").alias("age_hours"))


ART = """art AS (SELECT doc_id AS article_id, substr(string_split(text, chr(10))[1], 1, 120) AS title, substr(text, 1, 300) AS summary, text AS content,
 'https://WWW.' || source || '.example.com/a/' || (doc_id % 400) || '/?utm_source=x&b=' || (doc_id % 3) || '&a=1#top' AS url, source, lang, CAST(doc_id % 900 AS DOUBLE) AS age_hours FROM documents)"""
TOK = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STRIP = "html"
for _p, _b in (("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("(?s)<!--.*?-->", " "), ("<[^>]+>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("[ \\t\\n\\r\\f\\x0B]+", " "), (" ([.,;:!?])", "\\1")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_b}', 'g')"


@query(f"SELECT page_id, sha256(trim({_STRIP})) AS text_sha256, CAST(length(trim({_STRIP})) AS BIGINT) AS n FROM pages")
def html_to_text(spark, sf):
    t = news.strip_html(F.col("html"))
    return v.table(spark, sf, "pages").select("page_id", F.sha2(t, 256).alias("text_sha256"), F.length(t).cast("long").alias("n"))


@query(f"""WITH {ART}, u AS (SELECT url FROM art UNION ALL SELECT url FROM pages), p AS (SELECT regexp_extract(url, '^([^#]*)', 1) AS u, url FROM u),
q AS (SELECT url, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS s, regexp_replace(lower(regexp_extract(u, '://([^/?]*)', 1)), '^www\\.', '') AS h, regexp_replace(regexp_extract(u, '://[^/?]*([^?]*)', 1), '/+$', '') AS p,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains({_list(news.TRACKING)}, lower(regexp_extract(x, '^([^=]*)', 1))))), '&') AS q FROM p)
SELECT url, s || '://' || h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM q""")
def canonical_urls(spark, sf):
    u = articles(spark, sf).select("url").unionByName(v.table(spark, sf, "pages").select("url"))
    return u.select("url", news.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {ART} SELECT article_id, substr(lower(trim(regexp_replace(regexp_replace(title, '^\\s*\\[[^\\]]*\\]\\s*', ''), '\\s+-\\s+[^-]+$', ''))), 1, 200) AS title, substr(sha256(regexp_replace(lower(summary || ' ' || substr(content, 1, 500)), '[^a-z0-9 ]', '', 'g')), 1, 16) AS fingerprint FROM art")
def title_and_fingerprint(spark, sf):
    return articles(spark, sf).select("article_id", news.clean_title(F.col("title")).alias("title"), news.fingerprint(F.col("summary"), F.col("content")).alias("fingerprint"))


# The title ratio is beyond SQL; a test holds the rules against brute force.
@query()
def article_dedup(spark, sf):
    return news.dedup(articles(spark, sf)).select("article_id", "reason", F.coalesce("duplicate_of", F.lit(-1)).alias("duplicate_of"))


_J = f"list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: x <> ''))"  # noqa: F541


@query(f"""WITH {ART}, t AS (SELECT article_id, {_J} AS w FROM art) SELECT x.article_id AS a, y.article_id AS b, round(len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))), 6) AS jaccard FROM t x JOIN t y ON x.article_id < y.article_id WHERE len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) > 0.7""")
def title_jaccard(spark, sf):
    return v.rounded(news.token_jaccard(articles(spark, sf)))


@query()
def title_similarity(spark, sf):
    return v.rounded(news.similar_titles(articles(spark, sf)))


@query()
def title_groups(spark, sf):
    return news.title_groups(articles(spark, sf))


_SH = {k: f"len(list_filter(w, lambda x: list_contains({_list(m)}, x)))::DOUBLE / greatest(len(w), 1)" for k, m in news.LANGUAGES.items()}


@query(f"""WITH {ART}, t AS (SELECT article_id, {TOK.format('content')} AS w FROM art), s AS (SELECT article_id, len(w) AS n, {', '.join(f'{e} AS s_{k}' for k, e in _SH.items())} FROM t), b AS (SELECT *, greatest({', '.join(f's_{k}' for k in _SH)}) AS best FROM s)
SELECT article_id, CASE WHEN n = 0 OR best < 0.02 THEN 'en' {' '.join(f"WHEN s_{k} = best THEN '{k}'" for k in _SH)} END AS language, round(CASE WHEN n = 0 THEN 0.3 WHEN best < 0.02 THEN 0.4 ELSE least(best * 5, 0.85) END, 6) AS confidence FROM b""")
def language_id(spark, sf):
    d = articles(spark, sf).select("article_id", news.tokens(F.col("content")).alias("w"))
    lang, conf = news.language(F.col("w"))
    return v.rounded(d.select("article_id", lang.alias("language"), conf.alias("confidence")))


_SENT = f"""t AS (SELECT article_id, source, list_distinct({TOK.format("content || ' ' || CASE WHEN article_id % 3 = 0 THEN 'strong growth and record profit' WHEN article_id % 3 = 1 THEN 'loss, risks and one upgrade' ELSE '' END")}) AS w FROM art),
c AS (SELECT article_id, source, len(list_intersect(w, {_list(news.POSITIVE)})) AS p, len(list_intersect(w, {_list(news.NEGATIVE)})) AS n FROM t), s AS (SELECT article_id, source, p, n, CASE WHEN p + n = 0 THEN 0 ELSE (p - n)::DOUBLE / (p + n) END AS x FROM c),
sent AS (SELECT article_id, source, CASE WHEN x > 0.1 THEN 'positive' WHEN x < -0.1 THEN 'negative' ELSE 'neutral' END AS label, round(x, 3) AS score, round(least((p + n) / 10.0, 1) * 0.7 + 0.3, 3) AS confidence FROM s)"""


def _sentiment(spark, sf):
    extra = F.when(F.col("article_id") % 3 == 0, "strong growth and record profit").when(F.col("article_id") % 3 == 1, "loss, risks and one upgrade").otherwise("")
    d = articles(spark, sf).select("article_id", "source", news.tokens(F.concat("content", F.lit(" "), extra)).alias("w"))
    label, score, conf = news.sentiment(F.col("w"))
    return d.select("article_id", "source", label.alias("label"), score.alias("score"), conf.alias("confidence"))


@query(f"WITH {ART}, {_SENT} SELECT article_id, label, score, confidence FROM sent")
def sentiment_scores(spark, sf):
    return _sentiment(spark, sf).drop("source")


@query(f"""WITH {ART}, {_SENT}, g AS (SELECT source, count(*) AS n, count(*) FILTER (label = 'positive') AS n_positive, count(*) FILTER (label = 'negative') AS n_negative, count(*) FILTER (label = 'neutral') AS n_neutral, avg(score) AS m FROM sent GROUP BY 1)
SELECT source, n, n_positive, n_negative, n_neutral, round(m, 6) AS mean_score, CASE WHEN m > 0.15 THEN 'positive' WHEN m < -0.15 THEN 'negative' ELSE 'neutral' END AS overall FROM g""")
def sentiment_rollup(spark, sf):
    return v.rounded(news.roll_up(_sentiment(spark, sf), "source"))


@query(f"""WITH {ART}, e AS ({' UNION ALL '.join(f"SELECT article_id, '{k}' AS event, len(regexp_extract_all(lower(content), '{p}')) AS hits FROM art" for k, p in news.EVENTS.items())})
SELECT article_id, event, hits::BIGINT AS hits, round(least(0.5e0 + 0.1e0 * hits, 0.95e0), 6) AS confidence FROM e WHERE hits > 0""")
def event_detection(spark, sf):
    return v.rounded(news.events(articles(spark, sf)))


@query(f"""WITH {ART}, e AS ({' UNION ALL '.join(f"SELECT article_id, '{k}' AS kind, unnest(regexp_extract_all(content, '{p}')) AS text FROM art" for k, p in news.ENTITIES.items())}) SELECT article_id, kind, text, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def entity_extraction(spark, sf):
    return news.entities(articles(spark, sf))


@query(f"""WITH {ART}, m AS (SELECT lower(source) AS normalized, lang AS type, CASE WHEN article_id % 2 = 0 THEN 'rule' ELSE 'dictionary' END AS method, 0.5e0 + (article_id % 5) * 0.08e0 AS confidence FROM art), g AS (SELECT normalized, type, max(confidence) AS best, list_sort(list_distinct(list(method))) AS m FROM m GROUP BY 1, 2)
SELECT normalized, type, array_to_string(m, ',') AS methods, round(least(best + 0.1e0 * (len(m) - 1), 1), 6) AS confidence FROM g""")
def entity_merge(spark, sf):
    m = articles(spark, sf).select(F.lower("source").alias("normalized"), F.col("lang").alias("type"), F.when(F.col("article_id") % 2 == 0, "rule").otherwise("dictionary").alias("method"), (0.5 + (F.col("article_id") % 5) * 0.08).alias("confidence"))
    return v.rounded(news.merge_entities(m).withColumn("methods", F.array_join("methods", ",")))


@query(f"""WITH {ART} SELECT article_id, CASE WHEN age_hours <= 1 THEN 1.0e0 WHEN age_hours <= 6 THEN 0.9e0 WHEN age_hours <= 24 THEN 0.7e0 WHEN age_hours <= 72 THEN 0.5e0 WHEN age_hours <= 168 THEN 0.3e0 ELSE 0.1e0 END AS step, round(greatest(pow(2, -age_hours / 12), 0.05e0), 6) AS exponential, round(greatest(1 - age_hours / 720, 0), 6) AS linear FROM art""")
def freshness_scores(spark, sf):
    h = F.col("age_hours")
    return v.rounded(articles(spark, sf).select("article_id", news.freshness_step(h).alias("step"), news.freshness_exponential(h).alias("exponential"), news.freshness_linear(h).alias("linear")))


_REL = "least(1, least(len(regexp_extract_all(lower(content), 'the')) / 10.0e0, 0.7e0) + CASE WHEN contains(lower(title), 'the') THEN 0.3e0 ELSE 0 END)"
_FRESH = "greatest(pow(2, -age_hours / 12), 0.05e0)"


@query(f"""WITH {ART}, s AS (SELECT article_id, lang, {_REL} AS relevance, {_FRESH} AS freshness FROM art), c AS (SELECT *, least(0.6e0 * relevance + 0.4e0 * freshness, 1) AS x FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(x, 6) DESC, article_id) AS rank FROM c WHERE relevance >= 0.3)
SELECT article_id, lang, round(relevance, 6) AS relevance, round(x, 6) AS composite, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def ranked_articles(spark, sf):
    d = articles(spark, sf).select("article_id", "lang", news.relevance(F.col("content"), F.col("title"), "the").alias("relevance"), news.freshness_exponential(F.col("age_hours")).alias("freshness"))
    d = d.withColumn("composite", F.round(news.composite({"r": F.col("relevance"), "f": F.col("freshness")}, {"r": 0.6, "f": 0.4}), 6)).where("relevance >= 0.3")
    return v.rounded(news.top_per_group(d, "lang", "composite", "article_id", 20).drop("freshness"))


@query()
def quality_scores(spark, sf):
    return articles(spark, sf).select("article_id", news.quality(F.col("title"), F.col("summary"), F.col("content")).alias("quality"))
