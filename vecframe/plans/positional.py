"""Queries of scans, indexing, assignment, generators, lookups, concatenation, sorting and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as v
from ..functions.vec import Vec
from ..operators import generators as g
from ..operators import lookup as lo
from ..operators import matrix as m
from ..operators.frame import POSITION, Frame
from .registry import frame, query


def events(spark, d):
    return frame(spark, d, "events", "event_id")


def _keep(f: Frame, *names):
    return f.df.select(*names)


# -- scans
@query("SELECT event_id, round(sum(value) OVER w, 4) AS s, sum(user_id) OVER w::BIGINT AS i FROM events WINDOW w AS (ORDER BY event_id)")
def scan_cumsum(spark, d):
    f = events(spark, d).scan("sum", "value", "s").scan("sum", "user_id", "i")
    return f.df.select("event_id", F.round("s", 4).alias("s"), "i")


@query("SELECT event_id, round(exp(sum(ln(1 + (event_id % 7 - 3) / 1000.0)) OVER (ORDER BY event_id)), 6) AS p FROM events")
def scan_cumprod(spark, d):
    f = events(spark, d)
    f = f.with_(x=(f["event_id"] % 7 - 3) / 1000.0 + 1.0)
    return f.scan("prod", "x", "p").df.select("event_id", F.round("p", 6).alias("p"))


@query("SELECT event_id, min(value) OVER w AS lo, max(event_type) OVER w AS hi FROM events WINDOW w AS (ORDER BY event_id)")
def scan_cummin_cummax(spark, d):
    return _keep(events(spark, d).scan("min", "value", "lo").scan("max", "event_type", "hi"), "event_id", "lo", "hi")


@query("SELECT event_id, CASE WHEN event_id < 5000 THEN round(sum(x) OVER w, 4) END AS s, CASE WHEN event_id < 5000 THEN max(x) OVER w END AS hi FROM (SELECT event_id, CASE WHEN event_id % 10000 <> 5000 THEN value END AS x FROM events) WINDOW w AS (ORDER BY event_id)")
def scan_sticky_na(spark, d):
    f = events(spark, d)
    f = f.with_(x=Vec(F.when(F.col("event_id") % 10000 != 5000, F.col("value")), "double"))
    f = f.scan("sum", "x", "s").scan("max", "x", "hi")
    return f.df.select("event_id", F.round("s", 4).alias("s"), "hi")


@query("SELECT event_id, user_id, round(sum(value) OVER w, 4) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def scan_grouped(spark, d):
    f = events(spark, d).scan("sum", "value", "s", by=["user_id"])
    return f.df.select("event_id", "user_id", F.round("s", 4).alias("s"))


@query("SELECT event_id, bool_or(value > 99) OVER w AS some, bool_and(value > 0.01) OVER w AS every FROM events WINDOW w AS (ORDER BY event_id)")
def scan_cumany_cumall(spark, d):
    f = events(spark, d)
    f = f.with_(big=f["value"] > 99, plus=f["value"] > 0.01)
    return _keep(f.scan("any", "big", "some").scan("all", "plus", "every"), "event_id", "some", "every")


# -- indexing
@query("SELECT event_id, value FROM events WHERE value > 50")
def subset_filter(spark, d):
    f = events(spark, d)
    return _keep(f.filter(f["value"] > 50), "event_id", "value")


@query("SELECT event_id, value FROM events WHERE value > 50 AND user_id < 50 AND event_type = 'click'")
def subset_filter_nested(spark, d):
    f = events(spark, d)
    f = f.filter(f["value"] > 50)
    f = f.filter(f["user_id"] < 50)
    return _keep(f.filter(f["event_type"] == "click"), "event_id", "value")


@query("SELECT k, event_id, value FROM (SELECT o_orderkey AS k, o_custkey AS pos FROM orders) JOIN (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM events) USING (pos)")
def subset_gather(spark, d):
    asked = frame(spark, d, "orders").df.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("at"))
    return events(spark, d).gather(asked, "at", ["event_id", "value"]).where("event_id is not null").select("k", "event_id", "value")


@query("SELECT k, value FROM (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 100000000 ELSE o_custkey END AS pos FROM orders) LEFT JOIN (SELECT value, row_number() OVER (ORDER BY event_id) AS pos FROM events) USING (pos) WHERE pos IS NULL OR pos <> 0")
def subset_gather_na_zero(spark, d):
    k = F.col("o_orderkey") % 5
    at = F.when(k == 0, 0).when(k == 1, None).when(k == 2, 100000000).otherwise(F.col("o_custkey")).cast("bigint")
    asked = frame(spark, d, "orders").df.select(F.col("o_orderkey").alias("k"), at.alias("at"))
    return events(spark, d).gather(asked, "at", ["value"]).select("k", "value")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) WHERE pos NOT IN (SELECT o_custkey FROM orders)")
def subset_exclude(spark, d):
    gone = frame(spark, d, "orders").df.select("o_custkey")
    return _keep(events(spark, d).exclude(gone, "o_custkey"), "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) WHERE pos NOT IN (1, 3, 99, 100000000)")
def subset_exclude_few(spark, d):
    return _keep(events(spark, d).exclude([1, 3, 99, 100_000_000]), "event_id")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_name) - 1 AS i FROM customer")
def frame_index_text(spark, d):
    """An order of two columns of texts."""
    return frame(spark, d, "customer", ["c_mktsegment", "c_name"]).index().df.select("c_custkey", F.col(POSITION).alias("i"))


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM events) WHERE pos > (SELECT count(*) FROM events) - 5")
def subset_slice_end(spark, d):
    f = events(spark, d)
    n = f.df.count()
    i = f.index().df.where(F.col(POSITION) >= n - 5)
    return i.select("event_id", "value")


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts) AS pos FROM events) WHERE pos BETWEEN 11 AND 40")
def subset_slice(spark, d):
    return _keep(frame(spark, d, "events", "ts").slice(11, 40), "event_id", "value")


@query("SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS pos FROM events) WHERE pos = 17")
def subset_scalar(spark, d):
    return _keep(events(spark, d).slice(17, 17), "event_id", "value")


@query("SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS i FROM events")
def frame_index(spark, d):
    return frame(spark, d, "events", "ts").index().df.select("event_id", F.col(POSITION).alias("i"))


@query("SELECT event_id, coalesce(x, value) AS value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS pos FROM events) LEFT JOIN (SELECT c_custkey AS pos, c_acctbal AS x FROM customer) USING (pos)")
def assign_index(spark, d):
    new = frame(spark, d, "customer").df.select(F.col("c_custkey").alias("at"), F.col("c_acctbal").alias("x"))
    return _keep(events(spark, d).assign_at("value", new, "at", "x"), "event_id", "value")


@query("SELECT event_id, CASE WHEN value > 50 THEN 0.0 ELSE value END AS value, CASE WHEN value > 50 THEN 1 ELSE user_id END AS user_id FROM events")
def assign_mask(spark, d):
    f = events(spark, d)
    mask = f["value"] > 50
    return _keep(f.assign("user_id", mask, 1.9).assign("value", mask, 0), "event_id", "value", "user_id")


@query("SELECT event_id, CASE WHEN value > 50 THEN CASE (sum((value > 50)::INT) OVER (ORDER BY event_id) - 1) % 3 WHEN 0 THEN 7.0 WHEN 1 THEN 8.0 ELSE 9.0 END ELSE value END AS value FROM events")
def assign_mask_recycle(spark, d):
    f = events(spark, d)
    return _keep(f.assign("value", f["value"] > 50, [7, 8, 9]), "event_id", "value")


@query("SELECT i, round(x, 6) AS x FROM (SELECT row_number() OVER w AS i, 0.1 * lead(value, 1) OVER w + 0.15 * lead(value, 2) OVER w + 0.2 * lead(value, 3) OVER w + 0.3 * lead(value, 4) OVER w + 0.2 * lead(value, 5) OVER w + 0.15 * lead(value, 6) OVER w + 0.1 * lead(value, 7) OVER w AS x FROM events WINDOW w AS (ORDER BY event_id)) WHERE x IS NOT NULL")
def filter1d(spark, d):
    out = events(spark, d).stencil("value", [0.1, 0.15, 0.2, 0.3, 0.2, 0.15, 0.1], "x", block=1024)
    return out.select("i", F.round("x", 6).alias("x"))


# -- generators
def _gen(f: Frame):
    return f.df.select(F.col(POSITION).alias("i"), "x")


@query("SELECT i, 5 + i * 3 AS x FROM range(1000) t(i)")
def gen_seq_int(spark, d):
    return _gen(g.seq(spark, 5, 3, 1000))


@query("SELECT i, 0.5 + i::DOUBLE * 0.25 AS x FROM range(1000) t(i)")
def gen_seq_dbl(spark, d):
    return _gen(g.seq(spark, 0.5, 0.25, 1000))


@query("SELECT i, 10.0::DOUBLE - i AS x FROM range(14) t(i)")
def gen_colon_desc(spark, d):
    return _gen(g.colon(spark, 10.0, -3.0))


@query("SELECT i, (i // 3) % 4 + 1 AS x FROM range(100) t(i)")
def gen_index(spark, d):
    return _gen(g.index(spark, 4, 3, 100))


@query("SELECT i, CASE (i // 2) % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 2.5 ELSE 3.5 END::DOUBLE AS x FROM range(30) t(i)")
def gen_rep_each(spark, d):
    return _gen(g.rep(spark, [1.5, 2.5, 3.5], times=5, each=2))


@query("SELECT p_partkey, copy FROM (SELECT p_partkey, unnest(range(1, p_size % 4 + 1)) AS copy FROM part)")
def gen_rep_times_vec(spark, d):
    f = frame(spark, d, "part")
    f = f.with_(times=f["p_size"] % 4)
    return g.rep_times(f, "p_partkey", "times").select("p_partkey", "copy")


@query("SELECT i, 0.0::DOUBLE AS x FROM range(64) t(i)")
def gen_vector_fill(spark, d):
    return _gen(g.vector(spark, "double", 64))


@query("SELECT i, i + 1.0::DOUBLE AS x FROM range(50) t(i)")
def gen_seq_len(spark, d):
    return _gen(g.seq_len(spark, 50))


@query("SELECT i, 3 + i * 4 AS x FROM range(10) t(i)")
def gen_seq_int_by(spark, d):
    return _gen(g.seq_int(spark, 3, 41, 4))


@query()
def gen_runif_hash(spark, d):
    return _gen(g.runif(spark, 1000, 2.0, 5.0, seed=3))


@query("SELECT 1000::BIGINT AS n, true AS inside, 1000::BIGINT AS kinds, true AS centred, true AS again")
def gen_runif_moments(spark, d):
    """What a uniform sample must show: size, bounds, distinct draws, a mean within five standard errors; and equal draws for equal seeds."""
    one, two = (g.runif(spark, 1000, 2.0, 5.0, seed=3).df for _ in range(2))
    same = one.join(two.withColumnRenamed("x", "y"), POSITION)
    x = F.col("x")
    return same.agg(F.count(F.lit(1)).alias("n"), F.bool_and((x >= 2) & (x < 5)).alias("inside"), F.count_distinct("x").alias("kinds"), (F.abs(F.avg("x") - 3.5) < 5 * 0.866 / 31.6).alias("centred"), F.bool_and(x == F.col("y")).alias("again"))


# -- lookups
@query("SELECT o_orderkey, min(pos) AS match FROM orders LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) ON user_id = o_custkey GROUP BY o_orderkey")
def match_first(spark, d):
    return lo.match(frame(spark, d, "orders").df.select("o_orderkey", "o_custkey"), "o_custkey", events(spark, d), "user_id").select("o_orderkey", "match")


@query("SELECT o_orderkey, coalesce(min(pos), -1) AS match FROM orders LEFT JOIN (SELECT user_id, row_number() OVER (ORDER BY event_id) AS pos FROM events) ON user_id = o_custkey GROUP BY o_orderkey")
def match_nomatch(spark, d):
    return lo.match(frame(spark, d, "orders").df.select("o_orderkey", "o_custkey"), "o_custkey", events(spark, d), "user_id", nomatch=-1).select("o_orderkey", "match")


@query("SELECT s_suppkey, r_regionkey, s_acctbal * r_regionkey AS v FROM supplier, region")
def outer_product(spark, d):
    s, r = frame(spark, d, "supplier").df.select("s_suppkey", "s_acctbal"), frame(spark, d, "region").df.select("r_regionkey")
    return lo.outer(s, r, lambda x, y: x * y, "s_acctbal", "r_regionkey").drop("s_acctbal")


@query("SELECT s_suppkey, n_nationkey, greatest(s_nationkey, n_nationkey)::BIGINT AS v FROM supplier, nation")
def outer_fun(spark, d):
    s, n = frame(spark, d, "supplier").df.select("s_suppkey", "s_nationkey"), frame(spark, d, "nation").df.select("n_nationkey")
    return lo.outer(s, n, lambda x, y: F.greatest(x, y).cast("bigint"), "s_nationkey", "n_nationkey").drop("s_nationkey")


# -- concatenation, sorting
@query("SELECT 0::BIGINT AS part, r_regionkey::DOUBLE AS x FROM region UNION ALL SELECT 1, s_acctbal FROM supplier")
def concat_c_meet(spark, d):
    return lo.c((frame(spark, d, "region").df, "r_regionkey"), (frame(spark, d, "supplier").df, "s_acctbal"))


@query("SELECT vec_id, (i - 1)::INTEGER AS place, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def concat_unlist(spark, d):
    df = frame(spark, d, "embeddings").df
    return lo.unlist(df.select("vec_id", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("a")), "a", ["vec_id"])


@query("SELECT i, event_id, c_custkey FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, event_id FROM events) FULL JOIN (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey FROM customer) USING (i)")
def cbind_cols(spark, d):
    return lo.cbind(events(spark, d), frame(spark, d, "customer", "c_custkey"), ["event_id"], ["c_custkey"]).select(F.col(POSITION).alias("i"), "event_id", "c_custkey")


@query("SELECT event_id, value FROM events ORDER BY value, event_id")
def sort_dbl(spark, d):
    return lo.sort(events(spark, d), "value").select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY value, event_id LIMIT 20")
def sort_topk_slice(spark, d):
    return lo.sort(events(spark, d), "value").select("event_id", "value").limit(20)


@query("WITH r AS (SELECT user_id, row_number() OVER (ORDER BY event_id) AS pos FROM events), n AS (SELECT pos, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS k, min(pos) OVER (PARTITION BY user_id) AS one FROM r) SELECT coalesce((SELECT pos FROM n WHERE k = 2 ORDER BY one LIMIT 1), 0) AS first")
def any_duplicated(spark, d):
    return lo.any_duplicated(events(spark, d), "user_id")


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY event_id) AS p FROM events GROUP BY user_id")
def paste_collapse(spark, d):
    return lo.paste_collapse(events(spark, d), "event_type", ["user_id"], "|", "p")


# -- matrices: the 64 columns of embeddings, row i = vec_id + 1
WIDE = [f"x{k}" for k in range(1, 65)]
_LONG = "SELECT vec_id + 1 AS i, j, round(embedding[j]::DOUBLE, 6) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS j FROM embeddings)"


def wide(spark, d):
    df = frame(spark, d, "embeddings").df
    return df.select((F.col("vec_id") + 1).alias("i"), *[F.round(F.element_at("embedding", k).cast("double"), 6).alias(f"x{k}") for k in range(1, 65)])


def long(spark, d):
    return m.to_long(wide(spark, d), "i", WIDE)


@query(f"SELECT * FROM ({_LONG}) WHERE i = 3 OR j = 2")
def mat_index_row_col(spark, d):
    a = long(spark, d)
    return m.element(a, i=3).unionByName(m.element(a, j=2).where("i <> 3"))


@query(f"WITH a AS ({_LONG}) SELECT i, j, round(a.v * 2 + b.v / 4, 9) AS v FROM a JOIN a b USING (i, j)")
def mat_elementwise(spark, d):
    a = long(spark, d)
    return m.elementwise(a, a, lambda x, y: v.round_(x * 2 + y / 4, 9).col)


@query(f"SELECT i, j, v, i < j AS upper FROM ({_LONG})")
def mat_row_col_tri(spark, d):
    return m.upper_tri(long(spark, d))


@query(f"SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE v END AS v FROM ({_LONG})")
def mat_diag_assign(spark, d):
    return m.set_diag(long(spark, d), 1.0)


@query(f"SELECT round(sum(a.v * b.v), 6) AS v FROM ({_LONG}) a JOIN ({_LONG}) b ON a.i = b.i AND a.j = 1 AND b.j = 2")
def mat_inner(spark, d):
    return m.inner(wide(spark, d), "x1", "x2").select(F.round("v", 6).alias("v"))


@query(f"SELECT i, round(sum(v * j), 6) AS v FROM ({_LONG}) GROUP BY i")
def mat_vec(spark, d):
    return wide(spark, d).select("i", F.round(m.mat_vec(WIDE, [float(k) for k in range(1, 65)]), 6).alias("v"))


@query(f"WITH a AS ({_LONG}) SELECT " + ", ".join(f"round(sum(v * i) FILTER (j = {k}), 4) AS x{k}" for k in range(1, 65)) + " FROM a")
def vec_mat(spark, d):
    out = m.vec_mat(wide(spark, d), "i", WIDE)
    return out.select(*[F.round(c, 4).alias(c) for c in WIDE])


@query(f"WITH a AS ({_LONG}) SELECT x.j AS i, y.j AS j, round(sum(x.v * y.v), 4) AS v FROM a x JOIN a y ON x.i = y.i GROUP BY ALL")
def mat_mat(spark, d):
    a = long(spark, d)
    return m.mat_mat(m.transpose(a), a).select("i", "j", F.round("v", 4).alias("v"))


@query("SELECT i % 5 + 1 AS i, i // 5 + 1 AS j, (i * 2)::DOUBLE AS v FROM range(20) t(i)")
def mat_from_vector(spark, d):
    f = g.seq(spark, 0, 2, 20)
    return m.from_vector(f.df, POSITION, "x", 5)
