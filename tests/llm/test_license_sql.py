"""The SQL of the licence scan and the operator agree on texts with licences within lines, and on odd ones."""

import duckdb
import pandas as pd

from orrery.llm import licenses

MIT = licenses.TEMPLATES["MIT"][2]


def test_sql_equals_operator(spark):
    texts = [
        "This tool is Licensed under the Apache License, Version 2.0. See the docs.",
        "some words before " + MIT + " and some words after it, all on one line",
        "first\n\n" + MIT.replace("free of charge", "at no cost") + "\n\nlast",
        "Licensed under CC BY 4.0.\nReleased under the MIT License. Licensed under CC BY-SA 4.0.",
        "Licensed under the Licensed under the Apache License, Version 2.0.",
        "permission is hereby granted " * 40, "licensed", "", None, "the " * 3000 + "This is free and unencumbered software released into the public domain.",
        "LICENSED UNDER THE MIT LICENSE", "Übersetzt: licensed under the mit license - ende",
    ]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    rows = pd.concat([rows, rows[:2]])
    con = duckdb.connect()
    con.register("documents", rows)
    want = sorted(tuple(r) for r in con.sql(licenses.sql()).fetchall())
    kind = "doc_id long, text string"
    got = sorted(tuple(r) for r in licenses.find(spark.createDataFrame([(i, t) for i, t in zip(list(range(len(texts))) + [0, 1], texts + texts[:2])], kind)).collect())
    assert got == want
    assert dict((g[0], g[2]) for g in got)[0] == "Apache-2.0" and dict((g[0], g[2]) for g in got)[1] == "MIT"
