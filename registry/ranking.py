"""Sorting, ranking, top-n, sampling and set operations."""

from pyspark.sql import functions as F

from registry import query
from tidemark.operators import recon, select, xsec
from tidemark.session import stage


@query(
    "W21_rank_by_score",
    "signal_date:d symbol:i score:f rank:i",
    """SELECT signal_date, symbol, mom_12_1 AS score, CASE WHEN mom_12_1 IS NOT NULL THEN row_number() OVER (PARTITION BY signal_date ORDER BY mom_12_1 DESC NULLS LAST, symbol) END AS rank
       FROM month_features""",
)
def _(t):
    f = stage(t.month_features.select("signal_date", "symbol", F.col("mom_12_1").alias("score")))
    return xsec.ordinal_rank(f, ["signal_date"], "score", "symbol", "rank", descending=True)


@query(
    "W22_average_rank",
    "date:d symbol:i volume:f rank:f",
    """SELECT date, symbol, volume, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2 AS rank FROM bars""",
)
def _(t):
    return xsec.average_rank(stage(t.bars.select("date", "symbol", "volume")), ["date"], "volume", "rank")


@query(
    "W23_quantile_labels",
    "date:d symbol:i volume:f quantile:i",
    """SELECT date, symbol, volume, CASE WHEN n >= 10 AND lo < hi THEN greatest(1, ceil((r - 1) * 5 / (n - 1))) END AS quantile FROM (
       SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume, symbol) AS r, count(*) OVER (PARTITION BY date) AS n,
       min(volume) OVER (PARTITION BY date) AS lo, max(volume) OVER (PARTITION BY date) AS hi FROM bars)""",
)
def _(t):
    return xsec.quantile_label(stage(t.bars.select("date", "symbol", "volume")), ["date"], "volume", "symbol", 5)


@query(
    "T1_sort_nulls_last",
    "symbol:i date:d mom_12_1:f",
    "SELECT symbol, signal_date AS date, mom_12_1 FROM month_features ORDER BY mom_12_1 DESC NULLS LAST, symbol",
)
def _(t):
    f = t.month_features.select("symbol", F.col("signal_date").alias("date"), "mom_12_1")
    return f.orderBy(F.col("mom_12_1").desc_nulls_last(), "symbol", "date")


@query(
    "T2_top_n_per_date",
    "signal_date:d symbol:i amount:g rank:i",
    """SELECT signal_date, symbol, amount, row_number() OVER (PARTITION BY signal_date ORDER BY amount DESC, symbol) AS rank
       FROM month_features QUALIFY rank <= 20""",
)
def _(t):
    f = t.month_features.select("signal_date", "symbol", "amount")
    return select.top_n(f, ["signal_date"], [F.col("amount").desc(), F.col("symbol")], 20)


_RANKED = """(SELECT signal_date, symbol, row_number() OVER (PARTITION BY signal_date ORDER BY amount DESC, symbol) AS rank FROM month_features)"""
_HELD = "(SELECT (SELECT min(e.signal_date) FROM month_ends e WHERE e.signal_date > m.date) AS signal_date, symbol FROM membership m)"


def _ranked(t):
    return xsec.ordinal_rank(stage(t.month_features.select("signal_date", "symbol", "amount")), ["signal_date"], "amount", "symbol", "rank", True)


@query(
    "T3_buffered_top_n",
    "signal_date:d symbol:i rank:i was_held:b selection_reason:s",
    f"""WITH p AS (SELECT r.*, h.symbol IS NOT NULL AS was_held FROM {_RANKED} r LEFT JOIN {_HELD} h USING (signal_date, symbol) WHERE rank <= 30),
       k AS (SELECT *, CASE WHEN was_held THEN row_number() OVER (PARTITION BY signal_date, was_held ORDER BY rank) END AS kn FROM p),
       g AS (SELECT *, coalesce(kn <= 15, false) AS kept FROM k),
       f AS (SELECT *, 15 - sum(kept::INT) OVER (PARTITION BY signal_date) AS room,
         row_number() OVER (PARTITION BY signal_date, kept ORDER BY rank) AS fn FROM g)
       SELECT *, CASE WHEN kept THEN 'HOLD_BUFFER' ELSE 'NEW_ENTRY' END AS selection_reason FROM f WHERE kept OR fn <= room""",
)
def _(t):
    from pyspark.sql import Window

    steps = t.month_ends.select(
        F.col("signal_date").alias("date"), F.lead("signal_date").over(Window.orderBy("signal_date")).alias("signal_date")
    )
    held = t.membership.join(F.broadcast(steps), "date").select("signal_date", "symbol")
    return select.buffered_top_n(_ranked(t), held, 15, 30)


@query(
    "T4_trailing_rows",
    "signal_date:d symbol:i date:d close:f",
    """SELECT e.signal_date, b.symbol, b.date, b.close FROM month_ends e JOIN calendar c ON c.ord <= e.ord AND c.ord > e.ord - 10
       JOIN bars b ON b.date = c.date""",
)
def _(t):
    return select.trailing(t.bars.select("symbol", "date", "close"), t.calendar, t.month_ends, 10)


@query(
    "T5_stratified_sample",
    "segment:s custkey:i",
    """SELECT c_mktsegment AS segment, c_custkey AS custkey FROM customer
       QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256('20260101:' || c_custkey), c_custkey) <= 12""",
)
def _(t):
    c = t.raw("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("custkey"))
    return select.stratified_sample(c, "segment", "custkey", 12, 20260101)


_STRATA = ["rich", "BUILDING", "nation 3", "MACHINERY", "indebted"]
_IN_STRATA = """SELECT c_mktsegment AS segment, c_custkey AS custkey FROM customer UNION SELECT 'nation ' || c_nationkey, c_custkey FROM customer
   UNION SELECT 'rich', c_custkey FROM customer WHERE c_acctbal > 5000 UNION SELECT 'indebted', c_custkey FROM customer WHERE c_acctbal < 0"""


def _draws_sql(strata: list[str], n: int, seed: int) -> str:
    """One CTE a stratum, each without the keys of those before it."""
    steps, before = [f"rows AS ({_IN_STRATA})"], []
    for i, name in enumerate(strata):
        free = "".join(f" AND custkey NOT IN (SELECT custkey FROM draw{k})" for k in before)
        steps.append(f"draw{i} AS (SELECT segment, custkey FROM rows WHERE segment = '{name}'{free} ORDER BY sha256('{seed}:' || custkey), custkey LIMIT {n})")
        before.append(i)
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT * FROM draw{i}" for i in before)


@query("T5_sample_across_strata", "segment:s custkey:i", _draws_sql(_STRATA, 25, 20260101))
def _(t):
    c = t.raw("customer")
    by = lambda label, rows: rows.select(label.alias("segment"), F.col("c_custkey").alias("custkey"))
    rows = by(F.col("c_mktsegment"), c).unionByName(by(F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")), c))
    rows = rows.unionByName(by(F.lit("rich"), c.where("c_acctbal > 5000"))).unionByName(by(F.lit("indebted"), c.where("c_acctbal < 0")))
    return select.sample_without_replacement(rows, _STRATA, "segment", "custkey", 25, 20260101)


@query(
    "U1_union_all",
    "source:s symbol:i date:d amount:g",
    """SELECT 'a' AS source, symbol, date, amount FROM bars WHERE year(date) <= 1996 UNION ALL
       SELECT 'b', symbol, date, amount FROM bars WHERE year(date) >= 1996""",
)
def _(t):
    b = t.bars.select("symbol", "date", "amount")
    return b.where(F.year("date") <= 1996).withColumn("source", F.lit("a")).unionByName(
        b.where(F.year("date") >= 1996).withColumn("source", F.lit("b"))
    )


@query(
    "U2_nullable_union",
    "symbol:i date:d close:f volume:f note:s",
    """SELECT symbol, date, close, NULL AS volume, 'early' AS note FROM bars WHERE year(date) < 1997 UNION ALL
       SELECT symbol, date, close, volume, NULL FROM bars WHERE year(date) >= 1997""",
)
def _(t):
    early = t.bars.where(F.year("date") < 1997).select("symbol", "date", "close", F.lit("early").alias("note"))
    late = t.bars.where(F.year("date") >= 1997).select("symbol", "date", "close", "volume")
    return early.unionByName(late, allowMissingColumns=True)


@query(
    "U3_set_differences",
    "kind:s symbol:i",
    """WITH a AS (SELECT DISTINCT symbol FROM membership WHERE year(date) = 1996), b AS (SELECT DISTINCT symbol FROM membership WHERE year(date) = 2000 AND month(date) <= 2)
       SELECT 'missing' AS kind, symbol FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL
       SELECT 'extra', symbol FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL
       SELECT 'both', symbol FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
)
def _(t):
    m = stage(t.membership)
    a = m.where(F.year("date") == 1996).select("symbol").distinct()
    b = m.where((F.year("date") == 2000) & (F.month("date") <= 2)).select("symbol").distinct()
    tag = lambda kind, df: df.select(F.lit(kind).alias("kind"), "symbol")
    return (
        tag("missing", a.exceptAll(b)).unionByName(tag("extra", b.exceptAll(a))).unionByName(tag("both", a.intersect(b)))
    )


_COPY = """(SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS symbol,
   sum(l_extendedprice * CASE WHEN {changed} THEN 1.01::DOUBLE ELSE 1 END) / sum(l_quantity) AS close FROM lineitem GROUP BY 1, 2)"""


def copies(t):
    li = t.raw("lineitem")
    make = lambda price: li.groupBy(F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("symbol")).agg(
        (F.sum(price) / F.sum("l_quantity")).alias("close")
    )
    p = F.col("l_extendedprice")
    return make(p), make(F.when(F.col("l_orderkey") % 100 == 7, p * 1.01).otherwise(p))


@query(
    "U4_reconcile_copies",
    "month:d a_rows:i b_rows:i verdict:s",
    f"""WITH a AS (SELECT date_trunc('month', date)::DATE AS month, * FROM {_COPY.format(changed='false')}),
       b AS (SELECT date_trunc('month', date)::DATE AS month, * FROM {_COPY.format(changed='l_orderkey % 100 = 7 AND year(l_shipdate) = 1997')}
         WHERE year(date) < 2001)
       SELECT coalesce(a.month, b.month) AS month, count(a.date) AS a_rows, count(b.date) AS b_rows,
       CASE WHEN count(a.date) = 0 OR count(b.date) = 0 THEN 'inconclusive' WHEN bool_and(a.close IS NOT NULL AND b.close IS NOT NULL AND abs(a.close - b.close) < 1e-6)
         THEN 'match' ELSE 'mismatch' END AS verdict FROM a FULL JOIN b ON a.month = b.month AND a.date = b.date AND a.symbol = b.symbol GROUP BY 1""",
)
def _(t):
    a, b = copies(t)
    changed = F.year("date") == 1997
    shape = lambda df: df.select(F.trunc("date", "MM").alias("month"), "date", "symbol", "close")
    b = a.where(~changed & (F.year("date") < 2001)).unionByName(b.where(changed))
    return recon.reconcile_copies(shape(a), shape(b), ["date", "symbol"], ["month"], {"close": 1e-6})


@query(
    "U5_page_overlap",
    "request:i union_rows:i overlap_rows:i cap_broken:b disjoint:b",
    """WITH p AS (SELECT o_custkey % 50 AS request, o_orderkey // 7 AS k, o_orderkey % 4 AS page FROM orders),
       u AS (SELECT request, k, count(DISTINCT page) AS n FROM p GROUP BY 1, 2)
       SELECT request, count(*) AS union_rows, sum((n > 1)::INT) AS overlap_rows, count(*) > 290 AS cap_broken, sum((n > 1)::INT) = 0 AS disjoint FROM u GROUP BY 1""",
)
def _(t):
    p = t.raw("orders").select(
        (F.col("o_custkey") % 50).alias("request"), F.floor(F.col("o_orderkey") / 7).alias("k"), (F.col("o_orderkey") % 4).alias("page")
    )
    return recon.page_overlap(p, ["k"], 290)


_ARMS = """(SELECT signal_date, symbol, 'base' AS arm FROM month_features QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY amount DESC, symbol) <= 15
   UNION ALL SELECT signal_date, symbol, 'volume' FROM month_features QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY volume DESC, symbol) <= 15
   UNION ALL SELECT signal_date, symbol, 'price' FROM month_features QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY close DESC, symbol) <= 15)"""


def arms(t):
    f = stage(t.month_features.select("signal_date", "symbol", "amount", "volume", "close"))
    pick = lambda c, arm: select.top_n(f, ["signal_date"], [F.col(c).desc(), F.col("symbol")], 15).select(
        "signal_date", "symbol", F.lit(arm).alias("arm")
    )
    return pick("amount", "base").unionByName(pick("volume", "volume")).unionByName(pick("close", "price"))


@query(
    "U6_selection_overlap",
    "signal_date:d arm:s selected_count:i overlap:i jaccard:f",
    f"""WITH s AS {_ARMS}, d AS (SELECT DISTINCT signal_date FROM s), a AS (SELECT DISTINCT arm FROM s)
       SELECT d.signal_date, a.arm, count(x.symbol) AS selected_count, count(y.symbol) AS overlap,
       count(y.symbol) / (count(x.symbol) + (SELECT count(*) FROM s z WHERE z.arm = 'base' AND z.signal_date = d.signal_date) - count(y.symbol)) AS jaccard
       FROM d CROSS JOIN a LEFT JOIN s x ON x.signal_date = d.signal_date AND x.arm = a.arm
       LEFT JOIN s y ON y.signal_date = x.signal_date AND y.symbol = x.symbol AND y.arm = 'base' GROUP BY 1, 2""",
)
def _(t):
    return recon.selection_overlap(arms(t), "base", ["base", "volume", "price"])
