"""Gutters as wide as they must be, to the point, against the SQL."""

import duckdb
from folioscope.operators import pagelayout
from folioscope.plans.pagelayouts import _GUTTERS


def test_gutters_of_just_the_least_width(spark):
    rows = [(page, c - 5.0, 40.0, c + 5.0, 50.0, "w", 1, 1) for page, gap in ((1, 21.0), (2, 20.5), (3, 21.5)) for c in (255.0, 255.0 + gap)]
    rows += [(4, c - 5.0, 40.0, c + 5.0, 50.0, "w", 1, 1) for c in (252.0, 273.0, 327.0, 348.0)]  # ends on the band's borders
    words = spark.createDataFrame(rows, "page long, x0 double, y0 double, x1 double, y1 double, word string, block long, line long")
    c = duckdb.connect()
    c.execute("create table words (page bigint, x0 double, y0 double, x1 double, y1 double, word varchar, block bigint, line bigint)")
    c.executemany("insert into words values (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    want = c.execute(f"with {_GUTTERS.format('words')} select page, gutter, gap from gutters").fetchall()
    assert sorted(map(tuple, pagelayout.gutters(words, 600).collect())) == sorted(want)
    assert {w[0] for w in want} == {1, 3, 4}
