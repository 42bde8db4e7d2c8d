"""Entities, claims and filings in text: confidence, resolution of tickers and names, polarity, opposing claims, metadata."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base confidence and weight of the ways to find an entity.
SIGNALS = {
    "rule": (0.80, 1.0),
    "dictionary": (0.95, 2.0),
    "ner": (0.85, 1.5),
    "validated": (0.90, 2.0),
    "ticker": (0.95, 1.5),
    "company": (0.95, 1.5),
    "alias": (0.90, 1.0),
    "context": (0.70, 0.5),
    "cross_reference": (0.85, 1.0),
    "duplicate": (0.60, 0.5),
    "position": (0.75, 0.3),
}


def entity_confidence(mentions: DataFrame, by: list[str], signal: str = "signal") -> DataFrame:
    """(by, confidence, mentions): the weighted mean over the distinct signals of an entity, and over its repetition.

    A repeated entity has one more part of weight 0.5: 0.05 for each further mention, at most 0.2. The result is kept
    in [0.3, 1]. Signals that are unknown count 0.5 with weight 1; null signals are no signals.
    """
    pairs = [x for k, v in SIGNALS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("value"), F.lit(v[1]).alias("weight")))]
    known = F.coalesce(F.create_map(*pairs)[F.col("signal")], F.struct(F.lit(0.5).alias("value"), F.lit(1.0).alias("weight")))
    each = mentions.select(*by, F.col(signal).alias("signal")).groupBy(*by, "signal").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.when(F.col("signal").isNotNull(), known))
    g = each.groupBy(*by).agg(F.sum(F.col("k.value") * F.col("k.weight")).alias("got"), F.sum("k.weight").alias("weight"), F.sum("n").alias("mentions"))
    again = F.col("mentions") > 1
    got = F.coalesce("got", F.lit(0.0)) + F.when(again, 0.5 * F.least(0.05 * (F.col("mentions") - 1), F.lit(0.2))).otherwise(0.0)
    weight = F.coalesce("weight", F.lit(0.0)) + F.when(again, 0.5).otherwise(0.0)
    mean = F.coalesce(F.try_divide(got, weight), F.lit(0.5))
    return g.select(*by, F.least(F.greatest(mean, F.lit(0.3)), F.lit(1.0)).alias("confidence"), "mentions")


def _one_less(word: Column) -> Column:
    """The word, and all that it leaves when one character is deleted: words at distance one share such a form."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def resolve_tickers(mentions: DataFrame, listed: DataFrame, mention: str = "mention") -> DataFrame:
    """(mention, ticker, confidence) of every distinct mention; null ticker where nothing fits.

    In this order: the ticker itself .98, without an exchange suffix .95, another class of the share .95, an alias .9,
    one edit away .7 (both at least three characters). Listed has ticker and alias (null where there is none). Each step
    is an equi-join; the last one on forms with one character deleted, confirmed by the distance. Equal steps go to the
    least ticker.
    """
    m = mentions.select(F.col(mention).alias("mention")).where("mention is not null").distinct().withColumn("name", F.upper(F.trim("mention")))
    t = listed.select(F.upper("ticker").alias("ticker")).where("ticker is not null").distinct()
    base = F.regexp_replace("name", "\\.[A-Z]{2,3}$", "")
    share = F.regexp_replace("name", "[./-]([A-Z])$", "-$1")
    plain = m.select("mention", F.explode(F.array(F.struct(F.lit(0.98).alias("confidence"), F.col("name").alias("ticker")), F.struct(F.lit(0.95).alias("confidence"), base.alias("ticker")), F.struct(F.lit(0.95).alias("confidence"), share.alias("ticker")))).alias("k")).select("mention", "k.*")
    found = plain.join(t, "ticker").select("mention", "ticker", "confidence")
    aliases = listed.where("alias is not null and ticker is not null").select(F.upper(F.trim("alias")).alias("name"), F.upper("ticker").alias("ticker")).distinct()
    found = found.unionByName(m.join(aliases, "name").select("mention", "ticker", F.lit(0.9).alias("confidence")))
    left = m.where("length(name) >= 3").select("mention", "name", F.explode(_one_less(F.col("name"))).alias("form"))
    right = t.where("length(ticker) >= 3").select("ticker", F.explode(_one_less(F.col("ticker"))).alias("form"))
    close = left.join(right, "form").where(F.levenshtein("name", "ticker") == 1).select("mention", "ticker", F.lit(0.7).alias("confidence"))
    best = found.unionByName(close).groupBy("mention").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "ticker")).alias("b"))
    return m.select("mention").join(best, "mention", "left").select("mention", "b.ticker", (-F.col("b.minus")).alias("confidence"))


# Endings of company names that say nothing.
ENDINGS = "inc incorporated corp corporation co company llc ltd limited plc holdings group".split()


def plain_name(name: Column) -> Column:
    """A company's name in lower case, without punctuation and endings."""
    bare = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]+", " "))
    return F.trim(F.regexp_replace(bare, "(?:\\s+(?:" + "|".join(ENDINGS) + "))+$", ""))


def resolve_companies(mentions: DataFrame, companies: DataFrame, mention: str = "mention") -> DataFrame:
    """(mention, company, confidence) of every distinct mention: name .98, alias .95, plain name .9, initials .8; else null.

    Companies have company and alias (or null). All steps are equi-joins on one key; equal steps go to the least company.
    """
    m = mentions.select(F.col(mention).alias("mention")).where("mention is not null").distinct()
    initials = F.array_join(F.transform(F.split(plain_name(F.col("company")), "\\s+"), lambda w: F.substr(w, F.lit(1), F.lit(1))), "")
    key = lambda kind, x, score: F.struct(F.lit(kind).alias("kind"), x.alias("key"), F.lit(score).alias("confidence"))
    names = companies.where("company is not null").select("company", F.explode(F.array(key("name", F.lower(F.trim("company")), 0.98), key("name", F.lower(F.trim("alias")), 0.95), key("plain", plain_name(F.col("company")), 0.9), key("initials", F.when(F.length(initials) > 1, initials), 0.8))).alias("k")).select("company", "k.*").where("key <> ''")
    low = F.lower(F.trim("mention"))
    asked = m.select("mention", F.explode(F.array(key("name", low, 0.0), key("plain", plain_name(F.col("mention")), 0.0), key("initials", low, 0.0))).alias("k")).select("mention", "k.kind", "k.key")
    best = asked.join(names, ["kind", "key"]).groupBy("mention").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), "company")).alias("b"))
    return m.join(best, "mention", "left").select("mention", "b.company", (-F.col("b.minus")).alias("confidence"))


# What kinds of event say by themselves.
GOOD = ["earnings", "guidance", "product_launch", "partnership", "dividend", "share_buyback", "analyst_rating", "ipo"]
BAD = ["lawsuit", "regulatory", "layoffs", "bankruptcy", "short_report", "insider_trading", "management_change"]


def event_polarity(event: Column, sentiment: Column) -> Column:
    """positive, negative or neutral: by the kind of event, else by the sign of the article's label ('positive', ...)."""
    return F.when(event.isin(GOOD), "positive").when(event.isin(BAD), "negative").when(sentiment.isin("positive", "negative"), sentiment).otherwise("neutral")


def keyword_sentences(docs: DataFrame, words: list[str], most: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, place, sentence): the distinct sentences, lowered and trimmed, that hold a word; all, or the first `most` of a text.

    Sentences end at full stops; place is the position of the first of equal ones. Null texts have none.
    """
    held = F.filter(F.transform(F.split(F.lower(text), "\\."), lambda s: F.trim(s)), lambda s: s.rlike("|".join(words)))
    held = F.array_distinct(held)
    return docs.select(id, F.posexplode(held if most is None else F.slice(held, 1, most)).alias("place", "sentence"))


# Pairs of opposing terms.
OPPOSING = {
    "direction": (["bullish", "buy", "long", "positive", "outperform", "upgrade", "growth", "increase"], ["bearish", "sell", "short", "negative", "underperform", "downgrade", "decline", "decrease"]),
    "valuation": (["undervalued", "cheap", "discount", "margin of safety", "intrinsic value higher"], ["overvalued", "expensive", "premium", "intrinsic value lower", "bubble"]),
    "quality": (["strong moat", "competitive advantage", "pricing power", "high barriers"], ["no moat", "commodity", "low barriers", "intense competition"]),
    "health": (["strong balance sheet", "low debt", "high cash", "generating cash"], ["weak balance sheet", "high debt", "low cash", "burning cash"]),
    "growth": (["accelerating growth", "market share gains", "expanding tam"], ["decelerating growth", "market share losses", "shrinking tam"]),
}


def opposed(claims: DataFrame, by: str, id: str = "claim_id", text: str = "claim", lexicons: dict | None = None) -> DataFrame:
    """(by, id, lexicon, opposing): how many other claims of the same subject say the opposite, where any does.

    Two claims oppose each other if one has a term of one side and the other one a term of the other side. Counts come
    from sums of each subject (with one claim of both sides in each pair counted once), so no pairs are formed.
    """
    low = F.coalesce(F.lower(text), F.lit(""))
    has = lambda words: reduce(or_, [low.contains(w) for w in words]).cast("long")
    sides = F.array(*[F.struct(F.lit(k).alias("lexicon"), has(a).alias("up"), has(b).alias("down")) for k, (a, b) in (lexicons or OPPOSING).items()])
    d = claims.select(by, id, F.explode(sides).alias("s")).select(by, id, "s.*").where("up + down > 0")
    both = F.col("up") * F.col("down")
    sums = d.groupBy(by, "lexicon").agg(F.sum("up").alias("ups"), F.sum("down").alias("downs"), F.sum(both).alias("boths"))
    n = F.col("up") * F.col("downs") + F.col("down") * F.col("ups") - both * F.col("boths") - both
    return d.join(sums, [by, "lexicon"]).withColumn("opposing", n).where("opposing > 0").select(by, id, "lexicon", "opposing")


# Patterns of filings.
FORMS = {
    "10k": ["(?i)form\\s+10[- ]?k", "(?i)annual\\s+report\\s+pursuant\\s+to\\s+section\\s+13\\s+or\\s+15\\(d\\)"],
    "10q": ["(?i)form\\s+10[- ]?q", "(?i)quarterly\\s+report\\s+pursuant\\s+to\\s+section\\s+13\\s+or\\s+15\\(d\\)"],
    "8k": ["(?i)form\\s+8[- ]?k", "(?i)current\\s+report"],
    "annual_report": ["(?i)annual\\s+report\\s+(?:to\\s+shareholders|for\\s+the\\s+fiscal\\s+year)", "(?i)year\\s+ended\\s+\\w+\\s+\\d{4}"],
    "earnings": ["(?i)earnings\\s+(?:release|report|announcement)", "(?i)quarterly\\s+earnings", "(?i)q[1-4]\\s+\\d{4}\\s+earnings"],
    "presentation": ["(?i)investor\\s+presentation", "(?i)earnings\\s+presentation", "(?i)company\\s+presentation"],
}
CIK = ["(?i)cik\\s*[:\\-]?\\s*(\\d{10})", "(?i)central\\s+index\\s+key\\s*[:\\-]?\\s*(\\d{10})", "(?i)commission\\s+file\\s+number\\s*[:\\-]?\\s*(\\d{10})"]
ACCESSION = "(?i)accession\\s+number\\s*[:\\-]?\\s*(\\d{10}-\\d{2}-\\d{6})"
FISCAL_YEAR = "(?i)year\\s+(?:ended|ending)\\s*:?\\s*(?:\\w+\\s+\\d{1,2},\\s*)?(\\d{4})"
FISCAL_QUARTER = "(?i)(?:fiscal\\s+quarter\\s+|\\bq)([1-4])\\s"


def filing_metadata(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, form, cik, accession, fiscal_year, fiscal_quarter) from whole texts; what isn't found is null.

    The form is that with most hits of its patterns, the first of equals; years outside 1990 to 2030 are no years.
    """
    hits = lambda k: sum((F.regexp_count(text, F.lit(p)) for p in FORMS[k]), F.lit(0))
    d = docs.select(id, text, *[hits(k).alias(f"hits_{k}") for k in FORMS])
    most = F.greatest(*[F.col(f"hits_{k}") for k in FORMS])
    form = F.when(most > 0, F.coalesce(*[F.when(F.col(f"hits_{k}") == most, F.lit(k)) for k in FORMS]))
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    year = first(FISCAL_YEAR).cast("int")
    return d.select(id, form.alias("form"), F.coalesce(*[first(p) for p in CIK]).alias("cik"), first(ACCESSION).alias("accession"), F.when(year.between(1990, 2030), year).alias("fiscal_year"), first(FISCAL_QUARTER).cast("int").alias("fiscal_quarter"))
