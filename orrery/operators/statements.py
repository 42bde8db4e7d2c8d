"""Tables of filings out of HTML: rows and cells, the kind of statement, and its line items under canonical names.

All of it is built-in expressions over one scan; a page's tables are rows of their own, so pages of many tables spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of tables, tried in this order on all cells in lower case.
KINDS = {
    "income_statement": "consolidated\\s+statements?\\s+of\\s+(?:income|operations|earnings)|statement\\s+of\\s+(?:income|operations|earnings)|income\\s+statement|profit\\s+and\\s+loss|p&l|revenue|net\\s+income|earnings\\s+per\\s+share",
    "balance_sheet": "balance\\s+sheet|statement\\s+of\\s+financial\\s+position|assets|liabilities\\s+and\\s+(?:stockholders?\\s+)?equity|shareholders?\\s+equity",
    "cash_flow": "statements?\\s+of\\s+cash\\s+flow|cash\\s+flow\\s+statement|cash\\s+flows?\\s+from\\s+(?:operating|investing|financing)|(?:operating|investing|financing)\\s+activities",
    "comprehensive_income": "comprehensive\\s+income",
    "statement_of_changes_in_equity": "changes\\s+in\\s+equity",
    "segment_information": "segment\\s+information|(?:operating|reportable|business)\\s+segment",
    "notes_to_financial_statements": "note\\s+[0-9]+|notes?\\s+to\\s+(?:consolidated\\s+)?financial\\s+statements|footnotes",
}
ITEMS = {
    "revenue": ["revenue", "net sales", "sales"],
    "cost_of_revenue": ["cost of revenue", "cost of goods sold", "cogs", "cost of sales"],
    "gross_profit": ["gross profit", "gross margin"],
    "operating_expenses": ["operating expenses"],
    "research_development": ["research and development", "r&d", "research & development"],
    "sales_marketing": ["sales and marketing", "selling and marketing", "selling, general and administrative"],
    "general_admin": ["general and administrative", "g&a", "general & administrative"],
    "operating_income": ["operating income", "operating profit", "income from operations"],
    "interest_expense": ["interest expense", "interest income (expense)"],
    "other_income": ["other income"],
    "income_before_tax": ["income before tax", "income before income taxes", "pretax income"],
    "income_tax": ["income tax", "provision for income taxes"],
    "net_income": ["net income", "net earnings", "net profit", "net loss"],
    "eps_basic": ["basic earnings per share", "basic eps", "earnings per share - basic"],
    "eps_diluted": ["diluted earnings per share", "diluted eps", "earnings per share - diluted"],
    "cash": ["cash and cash equivalents", "cash"],
    "total_assets": ["total assets"],
    "total_liabilities": ["total liabilities"],
    "total_equity": ["total equity", "total stockholders' equity", "shareholders' equity"],
    "capex": ["capital expenditures", "purchases of property and equipment", "capex"],
    "free_cash_flow": ["free cash flow", "fcf"],
}
TABLE = "(?is)<table\\b.*?</table>|<article\\b.*?</article>"
ROW, CELL = "(?i)<(?:tr|p|li)\\b[^>]*>", "(?i)<(?:td|th|br)\\b[^>]*>"
NUMBER = "^-?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)$"


def cell_text(html: Column) -> Column:
    """Tags dropped, common entities decoded, white space collapsed."""
    for pattern, by in (("<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), ("[ \\t\\n\\r\\f\\x0B]+", " ")):
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


def digits(cell: Column) -> Column:
    """A cell without the signs of amounts: commas, currency, percent, brackets, dashes."""
    return F.trim(F.regexp_replace(cell, "[,$%()\\-]", ""))


def is_number(cell: Column) -> Column:
    return digits(cell).rlike(NUMBER)


def tables(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, table_no, rows: array of arrays of cells): tables, and articles as tables of paragraphs; empty rows and cells go."""
    rows = lambda t: F.filter(F.transform(F.slice(F.split(t, ROW), 2, 1 << 30), lambda r: F.filter(F.transform(F.split(r, CELL), cell_text), lambda c: c != "")), lambda r: F.size(r) > 0)
    d = pages.select(F.col(id).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TABLE), F.lit(0))).alias("table_no", "t"))
    return d.select("id", "table_no", rows(F.col("t")).alias("rows")).where(F.size("rows") > 0)


def classified(tables: DataFrame) -> DataFrame:
    """Adds kind and confidence: .3 for other, else .7 and .1 each for three or more cells in the first row (if it is a header,
    mostly text), more than 3 and more than 10 rows below it, and more than .3 of their cells numeric; at most 1."""
    d = tables.withColumn("text", F.lower(F.array_join(F.flatten("rows"), " ")))
    kind = F.coalesce(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in KINDS.items()], F.lit("other"))
    first = F.get("rows", 0)
    header = 2 * F.size(F.filter(first, lambda c: ~is_number(c))) > F.size(first)
    d = d.withColumns({"kind": kind, "header": header}).withColumn("body", F.when(F.col("header"), F.slice("rows", 2, 1 << 30)).otherwise(F.col("rows")))
    cells = F.flatten("body")
    numeric = F.coalesce(F.try_divide(F.size(F.filter(cells, is_number)).cast("double"), F.size(cells).cast("double")) > 0.3, F.lit(False))
    more = (F.col("header") & (F.size(first) > 2)).cast("int") + (F.size("body") > 3).cast("int") + (F.size("body") > 10).cast("int") + numeric.cast("int")
    return d.withColumn("confidence", F.when(F.col("kind") == "other", 0.3).otherwise(F.least(F.lit(1.0), F.round(0.7 + 0.1 * more, 1)))).drop("text", "header")


def line_items(classified: DataFrame, items: dict[str, list[str]] = ITEMS) -> DataFrame:
    """(id, table_no, kind, item, value): rows whose first cell holds an alias give the item their first numeric cell after it; of
    several rows of an item the last one counts. Values in brackets are negative."""
    row = classified.where("kind <> 'other'").select("id", "table_no", "kind", F.posexplode("body").alias("row_no", "cells"))
    label = F.lower(F.get("cells", 0))
    named = F.filter(F.array(*[F.when(F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(label, a)), F.lit(k)) for k, aliases in items.items()]), lambda k: k.isNotNull())
    amount = F.get(F.filter(F.slice("cells", 2, 1 << 30), is_number), 0)
    d = row.select("id", "table_no", "kind", "row_no", F.explode(named).alias("item"), amount.alias("cell")).where("cell is not null")
    minus = F.col("cell").startswith("(") | F.col("cell").startswith("-")
    value = digits(F.col("cell")).cast("double") * F.when(minus, -1.0).otherwise(1.0)
    return d.groupBy("id", "table_no", "kind", "item").agg(F.max_by(value, "row_no").alias("value"))
