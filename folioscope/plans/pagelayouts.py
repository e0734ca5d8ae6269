"""Pages put together from the boxes of their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import pagelayout
from folioscope.plans.base import query
from folioscope.sources.views import table

#: A supplier's lines as the words of a page of width 600: two columns for two suppliers of three, line numbers at the left margin. Reads the same in both dialects.
_BOX = """l_suppkey as page, cast(case when l_linenumber = 7 then 12 + l_partkey % 3 when l_suppkey % 3 = 0 then 60 + (l_partkey * 37) % 470 when l_partkey % 2 = 0 then 60 + (l_partkey * 37) % 190 else 330 + (l_partkey * 37) % 190 end as double) as x0,
    cast(40 + (l_orderkey % 50) * 14 + case when l_linenumber = 7 then 0 else l_partkey % 4 end as double) as y0, cast(10 + l_partkey % 3 as double) as h, cast(case when l_linenumber = 7 then 10 else 20 + l_orderkey % 5 end as double) as w,
    case when l_linenumber = 7 then cast(1 + l_orderkey % 50 as {string}) when l_partkey % 9 = 0 then cast(l_partkey as {string}) else concat('w', l_partkey % 100) end as word, case when l_linenumber = 7 then 1000 + l_orderkey else 1 end as block, l_orderkey % 50 as line"""
_WORDS = f"boxes as (select distinct page, x0, y0, x0 + w as x1, y0 + h as y1, word, block, line from (select {_BOX.format(string='varchar')} from lineitem))"


def _words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_split(_BOX.format(string="string")))
    return rows.selectExpr("page", "x0", "y0", "x0 + w as x1", "y0 + h as y1", "word", "block", "line").distinct()


def _split(listed: str) -> list[str]:
    """The expressions of a select list: commas outside brackets part them."""
    out, depth = [""], 0
    for c in listed:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


_GUTTERS = """pairs as (select page, c as b, lag(c) over (partition by page order by c) as a from (select page, (x0 + x1) / 2 as c from {0})), held as (select page, a, b from pairs where a >= 0.42 * 600 and b <= 0.58 * 600),
gutters as (select page, (a + b) / 2 as gutter, b - a as gap from held where b - a >= 0.035 * 600 qualify row_number() over (partition by page order by b - a desc, a) = 1)"""
_LINES = """facts as (select page, list_sort(list(y1 - y0)) as hs, list_sort(list(distinct y0)) as tops from {0} group by 1), tols as (select page, tops, greatest(0.6 * hs[len(hs) // 2 + 1], 3) as tol from facts),
starts(page, y) as (select page, tops[1] from tols union all select * from (select t.page, list_min(list_filter(t.tops, lambda v: v - s.y > t.tol)) as y from starts s join tols t on t.page = s.page) where y is not null),
placed as (select b.*, (select count(*) from starts s where s.page = b.page and s.y <= b.y0) as n from {0} b), lines as (select page, n as line, string_agg(word, ' ' order by x0, y0, word) as text from placed group by 1, 2)"""
_KEPT = """single as (select *, (x0 + x1) / 2 as c from (select *, count(*) over (partition by page, block, line) as n_line from boxes) where n_line = 1 and regexp_full_match(word, '[0-9]+')),
islands as (select *, sum(far) over (partition by page order by c, y0 rows unbounded preceding) as island from (select *, case when c - lag(c) over (partition by page order by c, y0) <= 20 then 0 else 1 end as far from single)),
steps as (select *, case when cast(word as bigint) >= lag(cast(word as bigint)) over (partition by page, island order by y0, c) then 1 else 0 end as rises from islands),
numbers as (select page, island from steps group by 1, 2 having count(*) >= 8 and (avg(c) < 0.15 * 600 or avg(c) > 0.85 * 600) and sum(rises) >= 0.7 * (count(*) - 1)),
kept as (select * from boxes anti join (select page, x0, y0, x1, y1, word, block, line from islands join numbers using (page, island)) using (page, x0, y0, x1, y1, word, block, line))"""


@query(f"with {_WORDS}, {_GUTTERS.format('boxes')} select page, gutter, gap from gutters")
def page_gutters(spark, sf_dir):
    return pagelayout.gutters(_words(spark, sf_dir), 600)


@query(f"with recursive {_WORDS}, {_LINES.format('boxes')} select page, cast(line as int) as line, text from lines")
def page_lines(spark, sf_dir):
    return pagelayout.text_lines(_words(spark, sf_dir))


@query(f"with {_WORDS}, {_KEPT} select page, x0, y0, word from kept")
def without_line_numbers(spark, sf_dir):
    return pagelayout.without_line_numbers(_words(spark, sf_dir), 600).select("page", "x0", "y0", "word")


@query(f"""with recursive {_WORDS}, {_KEPT}, {_GUTTERS.format('kept')}, sides as (select k.*, gutter, (x0 + x1) / 2 < gutter as is_left from kept k left join gutters using (page)),
counts as (select page, count(*) as n, count(*) filter (is_left) as l, count(*) filter (x0 < gutter and gutter < x1) as x from sides group by 1),
cols as (select page * 3 + case when gutter is null or n < 40 or x > 0.03 * n or l < 15 or n - l < 15 then 0 when is_left then 1 else 2 end as page, x0, y0, x1, y1, word from sides join counts using (page)), {_LINES.format('cols')}
select page // 3 as page, cast(page % 3 as int) as part, cast(line as int) as line, text from lines""")
def page_reading_order(spark, sf_dir):
    """Line numbers gone, then column by column, line by line."""
    return pagelayout.reading_order(_words(spark, sf_dir), 600)
