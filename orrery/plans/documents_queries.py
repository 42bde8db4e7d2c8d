"""Queries over documents and embeddings: evidence bundles, layered entity extraction, and the news chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import evidence, extraction, news, scoring, statements
from orrery.plans import news_queries as nq
from orrery.plans import views as v
from orrery.plans.registry import query


@query("""WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN ['general'] ELSE ['label ' || label, 'desk ' || vec_id % 7] END AS themes, list_transform(embedding, lambda x: x::DOUBLE) AS v, (vec_id % 11) / 10e0 AS relevance, 'k' || vec_id % 4 AS kind, CASE vec_id % 3 WHEN 0 THEN 'supporting' WHEN 1 THEN 'opposing' ELSE 'neutral' END AS stance FROM embeddings),
x AS (SELECT id, unnest(themes) AS theme, v, relevance, kind, stance FROM e), p AS (SELECT a.theme, avg(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) AS coherence FROM x a JOIN x b ON a.theme = b.theme AND a.id < b.id GROUP BY 1),
s AS (SELECT theme, stance, count(*) AS c FROM x GROUP BY 1, 2), m AS (SELECT theme, max(c) AS most, arg_min(stance, [-c, ord(stance)]) AS stance FROM s GROUP BY 1), g AS (SELECT theme, count(*) AS n, avg(relevance) AS r, count(DISTINCT kind) AS k FROM x GROUP BY 1 HAVING count(*) >= 2)
SELECT theme, n, round(coherence, 6) AS coherence, round(least(1, 0.7e0 * r + 0.3e0 * k / 10), 6) AS coverage, round(most / n::DOUBLE, 6) AS consensus, stance FROM g JOIN p USING (theme) JOIN m USING (theme)""")
def evidence_bundles(spark, sf):
    i = F.col("vec_id")
    themes = F.when(i % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("label "), "label"), F.concat(F.lit("desk "), i % 7)))
    stance = F.when(i % 3 == 0, "supporting").when(i % 3 == 1, "opposing")
    e = v.table(spark, sf, "embeddings").select(i.alias("id"), themes.alias("entities"), F.col("embedding").alias("v"), ((i % 11) / 10.0).alias("relevance"), F.concat(F.lit("k"), i % 4).alias("kind"), stance.alias("stance"))
    return v.rounded(evidence.bundles(e))


_EDGE = extraction.EDGES.replace("'", "''")
_CLEAN = f"regexp_replace(regexp_replace(w, '^{_EDGE}', ''), '{_EDGE}$', '')"
_KIND = " ".join(f"WHEN regexp_matches(token, '{p}') THEN '{k}'" for k, p, _ in extraction.RULES)
_CONF = " ".join(f"WHEN regexp_matches(token, '{p}') THEN {c}e0" for _, p, c in extraction.RULES)
_ENT = f"""raw AS (SELECT doc_id AS id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, lang FROM documents), tok AS (SELECT id, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM raw), t AS (SELECT id, pos, {_CLEAN} AS token FROM tok),
rules AS (SELECT id, pos, 1 AS n, CASE {_KIND} END AS kind, lower(token) AS entity, CASE {_CONF} END AS confidence, 'rule' AS method FROM t WHERE token <> '' AND CASE {_KIND} END IS NOT NULL),
g2 AS (SELECT id, pos, lower(token) || ' ' || lead(lower(token)) OVER (PARTITION BY id ORDER BY pos) AS phrase FROM t QUALIFY lead(pos) OVER (PARTITION BY id ORDER BY pos) IS NOT NULL), dict AS (SELECT phrase, min(lang) AS kind FROM g2 JOIN raw USING (id) WHERE pos = 0 GROUP BY 1),
found AS (SELECT id, pos, n, kind, entity, confidence, method FROM rules UNION ALL SELECT id, pos, 2, kind, phrase, 0.6e0, 'dictionary' FROM g2 JOIN dict USING (phrase)),
ent AS (SELECT id, kind, entity, count(*) AS mentions, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, round(least(1, max(confidence) + 0.1e0 * (count(DISTINCT method) - 1) + least(0.05e0 * (count(*) - 1), 0.15e0)), 6) AS confidence FROM found GROUP BY 1, 2, 3 HAVING round(least(1, max(confidence) + 0.1e0 * (count(DISTINCT method) - 1) + least(0.05e0 * (count(*) - 1), 0.15e0)), 6) >= 0.5)"""


def _extracted(spark, sf):
    """Each document's first two words, as they stand, are a name of the dictionary; all of them are looked for in all texts."""
    d = v.table(spark, sf, "documents").select("doc_id", "text", "lang")
    # Not by splitting whole texts.
    word = [F.regexp_extract(F.coalesce("text", F.lit("")), "^[\\x20\\x09-\\x0D]*([^\\x20\\x09-\\x0D]+)[\\x20\\x09-\\x0D]+([^\\x20\\x09-\\x0D]+)", k) for k in (1, 2)]
    clean = [F.lower(F.regexp_replace(F.regexp_replace(w, f"^{extraction.EDGES}", ""), f"{extraction.EDGES}$", "")) for w in word]
    names = d.where(word[1] != "").groupBy(F.concat_ws(" ", *clean).alias("phrase")).agg(F.min("lang").alias("kind")).withColumn("confidence", F.lit(0.6))
    return extraction.extract(d, names, 2)


@query(f"WITH {_ENT} SELECT id, kind, entity, mentions, methods, confidence FROM ent")
def text_entities(spark, sf):
    return _extracted(spark, sf)[0]


@query(f"WITH {_ENT}, k AS (SELECT f.id, f.pos, f.n, f.entity, lead(f.entity) OVER w AS b, lead(f.pos) OVER w - f.pos - f.n AS gap FROM found f JOIN ent USING (id, kind, entity) WINDOW w AS (PARTITION BY f.id ORDER BY f.pos, f.n, f.kind, f.entity)) SELECT id, entity AS a, b, count(*) AS n FROM k WHERE gap <= 12 AND b <> entity GROUP BY 1, 2, 3")
def text_relations(spark, sf):
    return _extracted(spark, sf)[1]


_SOURCES = {"src0": (1, 0.95, 120), "src1": (2, 0.85, 30), "src2": (3, 0.7, 12), "src3": (4, 0.6, 3)}
_STRIPPED = f"trim({nq._STRIP.replace('html', 'content')})"
_PARTS = f"""{nq._REL} AS relevance, {nq._FRESH} AS freshness, round(0.4e0 * CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 0.8e0 WHEN 'src2' THEN 0.7e0 WHEN 'src3' THEN 0.5e0 ELSE 0.4e0 END + 0.2e0 * CASE source WHEN 'src0' THEN 0.95e0 WHEN 'src1' THEN 0.85e0 WHEN 'src2' THEN 0.7e0 WHEN 'src3' THEN 0.6e0 ELSE 0.5e0 END
 + 0.15e0 * 0.3e0 + 0.15e0 * CASE source WHEN 'src0' THEN 1 WHEN 'src1' THEN 0.8e0 WHEN 'src2' THEN 0.7e0 ELSE 0.5e0 END + 0.1e0 * least(1, 0.5e0 + CASE source WHEN 'src0' THEN 0.3e0 WHEN 'src1' THEN 0.2e0 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'methodology|how we calculated|data source:|source:') THEN 0.1e0 ELSE 0 END), 3) AS credibility,
 least(1, length(content) / 3000e0) AS quality, least(1, CASE WHEN length(content) >= 2000 THEN 0.3e0 WHEN length(content) >= 1000 THEN 0.2e0 WHEN length(content) >= 300 THEN 0.1e0 ELSE 0 END + least(0.05e0 * len(regexp_extract_all(content, '[0-9]+%')), 0.3e0)) AS importance, least(1, 0.4e0 + CASE WHEN regexp_matches(content, '[$][0-9]') THEN 0.1e0 ELSE 0 END) AS impact"""


@query(f"""WITH {nq.ART}, every AS (SELECT *, CASE WHEN article_id % 2 = 0 THEN 0 ELSE 1 END AS priority, lower(source) || '/' || article_id % 400 || '/' || article_id % 3 AS k FROM art), one AS (SELECT * REPLACE ({_STRIPPED} AS content) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, article_id) AS i FROM every) WHERE i = 1),
fresh AS (SELECT *, min(article_id) OVER (PARTITION BY content) AS f1, min(article_id) OVER (PARTITION BY substr(sha256(regexp_replace(lower(summary || ' ' || substr(content, 1, 500)), '[^a-z0-9 ]', '', 'g')), 1, 16)) AS f2 FROM one), s AS (SELECT article_id, lang, {_PARTS} FROM fresh WHERE f1 = article_id AND f2 = article_id),
c AS (SELECT *, round(least(1, 0.25e0 * relevance + 0.20e0 * freshness + 0.15e0 * credibility + 0.20e0 * quality + 0.10e0 * importance + 0.10e0 * impact), 6) AS composite FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY composite DESC, article_id) AS rank FROM c WHERE composite >= 0.3)
SELECT article_id, lang, round(relevance, 6) AS relevance, round(credibility, 6) AS credibility, composite, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def news_chain(spark, sf):
    """Two providers, the first of which has every other article; all rules of equality; all six parts of the composite."""
    every = nq.articles(spark, sf).withColumn("author", F.lit(None).cast("string"))
    content, n = F.col("content"), F.length("content")
    parts = {
        "relevance": news.relevance(content, F.col("title"), "the"),
        "freshness": news.freshness_exponential(F.col("age_hours")),
        "credibility": scoring.credibility(F.col("source"), F.col("author"), content, _SOURCES),
        "quality": F.least(F.lit(1.0), n / 3000.0),
        "importance": scoring.importance(n, F.regexp_count(content, F.lit("[0-9]+%")), F.lit(0)),
        "impact": scoring.market_impact(F.lit(0.4), F.lit(0.0), F.lit(False), F.regexp_count(content, F.lit("[$][0-9]"))),
    }
    out = news.process([every.where("article_id % 2 = 0"), every], parts, similar=False)
    return v.rounded(out.select("article_id", "lang", "relevance", "credibility", "composite", "rank"))


# Statements: an income table and a balance sheet of each nation, made from its orders; and the articles of all pages.
_HTML = """st AS (SELECT 'n' || n_nationkey AS id, '<table><tr><th>Consolidated statements of income</th><th>1998</th><th>1997</th></tr><tr><td>Net revenue</td><td>$' || CAST(round(sum(o_totalprice)) AS BIGINT) || '</td></tr><tr><td>Cost of sales</td><td>n/a</td><td>(' || count(*) || ')</td></tr><tr><td>Income tax</td><td></td></tr><tr><td>Net income</td><td>' || n_nationkey || '.5%</td></tr></table>
<p>between</p><TABLE><tr><td>Total assets</td><td>' || n_nationkey || ',000</td></tr><tr><td>Total liabilities &amp; equity</td><td>-' || count(DISTINCT c_custkey) || '</td></tr></TABLE>' AS html FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey UNION ALL SELECT 'p' || page_id, html FROM pages)"""


def _statements(spark, sf):
    t = lambda n: v.table(spark, sf, n)
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.round(F.sum("o_totalprice")).cast("bigint").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("m"))
    k = F.col("c_nationkey").cast("string")
    html = F.concat(
        F.lit("<table><tr><th>Consolidated statements of income</th><th>1998</th><th>1997</th></tr><tr><td>Net revenue</td><td>$"), F.col("total").cast("string"), F.lit("</td></tr><tr><td>Cost of sales</td><td>n/a</td><td>("), F.col("n").cast("string"), F.lit(")</td></tr><tr><td>Income tax</td><td></td></tr><tr><td>Net income</td><td>"), k,
        F.lit(".5%</td></tr></table>\n<p>between</p><TABLE><tr><td>Total assets</td><td>"), k, F.lit(",000</td></tr><tr><td>Total liabilities &amp; equity</td><td>-"), F.col("m").cast("string"), F.lit("</td></tr></TABLE>"),
    )
    made = o.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("n"), k).alias("id"), html.alias("html"))
    every = made.unionByName(t("pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "html"))
    return statements.classified(statements.tables(every, "id"))


def _cells(x: str) -> str:
    for p, b in (("<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("[ \\t\\n\\r\\f\\x0B]+", " ")):
        x = f"regexp_replace({x}, '{p}', '{b}', 'g')"
    return f"trim({x})"


_NUM = "regexp_matches(trim(regexp_replace({0}, '[,$%()\\-]', '', 'g')), '" + statements.NUMBER + "')"
_TABS = f"""{_HTML}, tb AS (SELECT id, generate_subscripts(l, 1) - 1 AS table_no, unnest(l) AS t FROM (SELECT id, regexp_extract_all(html, '{statements.TABLE}') AS l FROM st)), rw AS (SELECT id, table_no, list_filter(list_transform(string_split_regex(t, '{statements.ROW}')[2:], lambda r: list_filter(list_transform(string_split_regex(r, '{statements.CELL}'), lambda c: {_cells('c')}), lambda c: c <> '')), lambda r: len(r) > 0) AS rs FROM tb),
cl AS (SELECT *, lower(array_to_string(flatten(rs), ' ')) AS txt, 2 * len(list_filter(rs[1], lambda c: NOT {_NUM.format('c')})) > len(rs[1]) AS header FROM rw WHERE len(rs) > 0), ck AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(txt, '{p}') THEN '{k}'" for k, p in statements.KINDS.items())} ELSE 'other' END AS kind, CASE WHEN header THEN rs[2:] ELSE rs END AS body FROM cl)"""


@query(f"""WITH {_TABS} SELECT id, CAST(table_no AS INT) AS table_no, kind, CAST(len(body) AS INT) AS n_rows, CASE WHEN kind = 'other' THEN 0.3e0 ELSE least(1, round(0.7e0 + 0.1e0 * (CAST(header AND len(rs[1]) > 2 AS INT) + CAST(len(body) > 3 AS INT) + CAST(len(body) > 10 AS INT) + CAST(coalesce(len(list_filter(flatten(body), lambda c: {_NUM.format('c')})) / nullif(len(flatten(body)), 0)::DOUBLE > 0.3, false) AS INT)), 1)) END AS confidence FROM ck""")
def statement_tables(spark, sf):
    return _statements(spark, sf).select("id", "table_no", "kind", F.size("body").alias("n_rows"), "confidence")


@query(f"""WITH {_TABS}, r AS (SELECT id, table_no, kind, generate_subscripts(body, 1) AS row_no, unnest(body) AS cells FROM ck WHERE kind <> 'other'), a AS (SELECT * FROM (VALUES {', '.join(f"('{k}', [{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in al)}])" for k, al in statements.ITEMS.items())}) a(item, aliases)),
h AS (SELECT id, table_no, kind, item, row_no, list_filter(cells[2:], lambda c: {_NUM.format('c')})[1] AS cell FROM r, a WHERE len(list_filter(aliases, lambda x: contains(lower(cells[1]), x))) > 0)
SELECT id, CAST(table_no AS INT) AS table_no, kind, item, arg_max(CAST(trim(regexp_replace(cell, '[,$%()\\-]', '', 'g')) AS DOUBLE) * CASE WHEN cell LIKE '(%' OR cell LIKE '-%' THEN -1 ELSE 1 END, row_no) AS value FROM h WHERE cell IS NOT NULL GROUP BY 1, 2, 3, 4""")
def statement_items(spark, sf):
    return statements.line_items(_statements(spark, sf))
