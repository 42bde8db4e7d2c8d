"""Statement tables on small pages."""

import pytest

from orrery.operators import statements

PAGE = """<h1>Report</h1><table class="a"><tr><th>Balance sheets</th><th>2023</th><th>2022</th></tr>
<tr><td>Cash and cash equivalents</td><td></td><td>$1,200.50</td></tr><tr><td> Total&nbsp;assets </td><td>n/m</td><td>(300)</td><td>7</td></tr>
<TR><TD>Total assets</TD><TD>5%</TD></TR><tr></tr><tr><td>Total equity</td><td>--</td></tr></table>
<table><tr><td>Opening hours</td><td>9</td></tr></table>"""


def test_tables_kinds_and_items(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "no tables"), (4, "<article><p>Net revenue<br>12<br>13<p>words only</article>"), (5, "<table></table>")], "page_id long, html string")
    found = statements.classified(statements.tables(df))
    kinds = {(r.id, r.table_no): (r.kind, r.confidence, len(r.body)) for r in found.collect()}
    # Years are numbers, so the first row is no header.
    assert kinds == {(1, 0): ("balance_sheet", pytest.approx(0.9), 5), (1, 1): ("other", 0.3, 1), (4, 0): ("income_statement", pytest.approx(0.8), 2)}
    got = {(r.id, r.item): r.value for r in statements.line_items(found).collect()}
    # Of two rows of one item the later one counts; brackets are a minus; a row without a number gives nothing.
    assert got == {(1, "cash"): 1200.5, (1, "total_assets"): 5.0, (4, "revenue"): 12.0}


def test_brackets_and_dashes(spark):
    df = spark.createDataFrame([(1, "<table><tr><td>Capex</td><td>-5</td></tr><tr><td>Net loss</td><td>text</td><td>(1,234)</td></tr></table>")], "page_id long, html string")
    got = {r.item: r.value for r in statements.line_items(statements.classified(statements.tables(df)).withColumn("kind", statements.F.lit("income_statement"))).collect()}
    assert got == {"net_income": -1234.0, "capex": -5.0}
