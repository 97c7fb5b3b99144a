"""Queries of folds and grouped folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as v
from ..functions.vec import Vec
from ..operators import folds as fo
from ..operators.frame import Frame, encode
from .elementwise import KLEENE_A, kleene
from .registry import frame, query


def _rounded(df, **digits):
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("SELECT sum(l_partkey)::BIGINT AS isum, round(sum(l_quantity), 2) AS dsum, (SELECT round(product(1 + r_regionkey * 0.1), 9) FROM region) AS p FROM lineitem")
def fold_sum_prod(spark, d):
    f, r = frame(spark, d, "lineitem"), frame(spark, d, "region")
    p = r.with_(x=r["r_regionkey"] * 0.1 + 1.0)
    both = f.fold(isum=fo.sum_(f["l_partkey"]), dsum=fo.sum_(f["l_quantity"])).join(F.broadcast(p.fold(p=fo.prod(p["x"]))))
    return _rounded(both, dsum=2, p=9)


@query("SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, min(l_partkey) AS ilo, max(l_partkey) AS ihi FROM lineitem")
def fold_min_max(spark, d):
    f = frame(spark, d, "lineitem")
    return f.fold(lo=fo.min_(f["l_extendedprice"]), hi=fo.max_(f["l_extendedprice"]), ilo=fo.min_(f["l_partkey"]), ihi=fo.max_(f["l_partkey"]))


@query("SELECT min(c_name) AS lo, max(c_mktsegment) AS hi FROM customer")
def fold_min_max_str(spark, d):
    f = frame(spark, d, "customer")
    return f.fold(lo=fo.min_(f["c_name"]), hi=fo.max_(f["c_mktsegment"]))


@query(f"SELECT bool_or(a) AS some, bool_and(a) AS every, CASE WHEN bool_or(n) THEN true WHEN count(*) > count(n) THEN NULL ELSE false END AS none FROM (SELECT {KLEENE_A} AS a, CASE WHEN event_id % 3 > 0 THEN false END AS n FROM events)")
def fold_any_all(spark, d):
    f = kleene(spark, d)
    f = f.with_(n=Vec(F.when(F.col("event_id") % 3 > 0, False), "logical"))
    return f.fold(some=fo.any_(f["a"]), every=fo.all_(f["a"]), none=fo.any_(f["n"]))


@query("SELECT count(*) AS n, round(avg(l_extendedprice), 4) AS m FROM lineitem")
def fold_length_mean(spark, d):
    f = frame(spark, d, "lineitem")
    return _rounded(f.fold(n=fo.length(), m=fo.mean(f["l_extendedprice"])), m=4)


@query("SELECT round(var_samp(l_quantity), 6) AS v, round(stddev_samp(l_discount), 9) AS s FROM lineitem")
def fold_var_sd(spark, d):
    f = frame(spark, d, "lineitem")
    return _rounded(f.fold(v=fo.var(f["l_quantity"]), s=fo.sd(f["l_discount"])), v=6, s=9)


@query("SELECT round(covar_samp(l_quantity, l_discount), 9) AS c, round(covar_pop(l_quantity, l_extendedprice) * count(*) / 1e6, 3) AS m FROM lineitem")
def fold_cov_cm2(spark, d):
    f = frame(spark, d, "lineitem")
    out = f.fold(c=fo.cov(f["l_quantity"], f["l_discount"]), m=fo.cm2(f["l_quantity"], f["l_extendedprice"]))
    return out.select(F.round("c", 9).alias("c"), F.round(F.col("m") / 1e6, 3).alias("m"))


def _with_na(spark, d):
    f = frame(spark, d, "events")
    return f.with_(x=Vec(F.when(F.col("event_id") % 10 > 0, F.col("value")), "double"))


@query("SELECT NULL::DOUBLE AS s, NULL::DOUBLE AS lo, NULL::DOUBLE AS m, count(*) AS n FROM events")
def fold_na_propagate(spark, d):
    f = _with_na(spark, d)
    return f.fold(s=fo.sum_(f["x"]), lo=fo.min_(f["x"]), m=fo.mean(f["x"]), n=fo.length(f["x"]))


@query("SELECT round(sum(x), 4) AS s, min(x) AS lo, round(avg(x), 6) AS m FROM (SELECT CASE WHEN event_id % 10 > 0 THEN value END AS x FROM events)")
def fold_na_rm(spark, d):
    f = _with_na(spark, d)
    return _rounded(f.fold(s=fo.sum_(f["x"], na_rm=True), lo=fo.min_(f["x"], na_rm=True), m=fo.mean(f["x"], na_rm=True)), s=4, m=6)


@query("SELECT 0.0::DOUBLE AS s, 0::BIGINT AS i, 1.0::DOUBLE AS p, 'inf'::DOUBLE AS lo, '-inf'::DOUBLE AS hi, 0::BIGINT AS n, NULL::DOUBLE AS m, false AS some, true AS every")
def fold_empty_identity(spark, d):
    f = frame(spark, d, "lineitem").filter(Vec(F.lit(False), "logical"))
    q = f["l_quantity"]
    return f.fold(s=fo.sum_(q), i=fo.sum_(f["l_partkey"]), p=fo.prod(q), lo=fo.min_(q), hi=fo.max_(q), n=fo.length(), m=fo.mean(q), some=fo.any_(q > 0), every=fo.all_(q > 0))


@query("SELECT round(sum(l_extendedprice) FILTER (l_discount > 0.05), 2) AS s, count(*) FILTER (l_discount > 0.05) AS n, max(l_quantity) FILTER (l_tax > 0.02) AS hi FROM lineitem")
def fold_masked(spark, d):
    f = frame(spark, d, "lineitem")
    m = f["l_discount"] > 0.05
    return _rounded(f.fold(s=fo.sum_(f["l_extendedprice"], where=m), n=fo.length(where=m), hi=fo.max_(f["l_quantity"], where=f["l_tax"] > 0.02)), s=2)


@query("SELECT round(sum(l_quantity), 2) AS a, round(sum(l_extendedprice * l_discount), 2) AS b, max(l_tax) AS c, count(*) AS n, bool_or(l_quantity > 49) AS big FROM lineitem")
def fold_multi(spark, d):
    f = frame(spark, d, "lineitem")
    return _rounded(f.fold(a=fo.sum_(f["l_quantity"]), b=fo.sum_(f["l_extendedprice"] * f["l_discount"]), c=fo.max_(f["l_tax"]), n=fo.length(), big=fo.any_(f["l_quantity"] > 49)), a=2, b=2)


def _group(name, sql, make, **digits):
    def run(spark, d):
        f = frame(spark, d, "lineitem")
        return _rounded(f.split("l_suppkey").fold(**make(f)), **digits)

    run.__name__ = name
    query(f"SELECT l_suppkey, {sql} FROM lineitem GROUP BY l_suppkey")(run)


_group("group_sum", "round(sum(l_extendedprice), 2) AS s, sum(l_linenumber)::BIGINT AS i", lambda f: {"s": fo.sum_(f["l_extendedprice"]), "i": fo.sum_(f["l_linenumber"])}, s=2)
_group("group_mean", "round(avg(l_quantity), 6) AS m", lambda f: {"m": fo.mean(f["l_quantity"])}, m=6)
_group("group_length", "count(*) AS n", lambda f: {"n": fo.length()})
_group("group_min_max", "min(l_extendedprice) AS lo, max(l_returnflag) AS hi", lambda f: {"lo": fo.min_(f["l_extendedprice"]), "hi": fo.max_(f["l_returnflag"])})
_group("group_prod", "round(product(1 + l_tax / 100), 6) AS p", lambda f: {"p": fo.prod(1 + f["l_tax"] / 100)}, p=6)
_group("group_cm2", "round(covar_pop(l_quantity, l_tax) * count(*), 6) AS c", lambda f: {"c": fo.cm2(f["l_quantity"], f["l_tax"])}, c=6)


@query(
    "SELECT code, coalesce(round(s, 2), 0.0) AS s, coalesce(n, 0) AS n, coalesce(lo, 'inf'::DOUBLE) AS lo, m FROM (SELECT unnest(range(8)) AS code) LEFT JOIN "
    "(SELECT l_linenumber + CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END AS code, sum(l_quantity) AS s, count(*) AS n, min(l_tax) AS lo, round(avg(l_tax), 6) AS m FROM lineitem GROUP BY 1) USING (code)"
)
def group_dense_empty(spark, d):
    f = frame(spark, d, "lineitem")
    n = f["l_linenumber"]
    f = f.with_(code=n + v.ifelse(n > 2, 1, 0))
    out = f.split("code").dense(8, s=fo.sum_(f["l_quantity"]), n=fo.length(), lo=fo.min_(f["l_tax"]), m=fo.mean(f["l_tax"]))
    return _rounded(out, s=2, m=6)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS s, count(*) AS n FROM lineitem GROUP BY ALL")
def group_two_keys(spark, d):
    f = frame(spark, d, "lineitem")
    return _rounded(f.split("l_returnflag", "l_linestatus").fold(s=fo.sum_(f["l_quantity"]), n=fo.length()), s=2)


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS s, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY ALL")
def group_filtered(spark, d):
    f = frame(spark, d, "orders")
    m = f["o_orderstatus"] == "F"
    return _rounded(f.split("o_orderpriority").fold(s=fo.sum_(f["o_totalprice"], where=m), n=fo.length(where=m)), s=2)


@query("SELECT l_partkey, round(sum(l_extendedprice), 2) AS s, count(*) AS n FROM lineitem GROUP BY l_partkey")
def group_high_cardinality(spark, d):
    f = frame(spark, d, "lineitem")
    return _rounded(f.split("l_partkey").fold(s=fo.sum_(f["l_extendedprice"]), n=fo.length()), s=2)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 2 END::BIGINT AS code FROM customer")
def factor_codes(spark, d):
    f = frame(spark, d, "customer")
    return f.df.select("c_custkey", encode(f["c_mktsegment"], ["BUILDING", "AUTOMOBILE", "MACHINERY"]).cast("bigint").alias("code"))


@query("SELECT code, count(l_quantity) AS n FROM (SELECT unnest(range(51)) AS code) LEFT JOIN lineitem ON l_quantity::BIGINT = code GROUP BY code")
def histogram(spark, d):
    f = frame(spark, d, "lineitem")
    f = f.with_(code=v.as_integer(f["l_quantity"]))
    return f.split("code").dense(51, n=fo.length())


@query("SELECT l_suppkey, round(x, 4) AS x FROM (SELECT l_suppkey, sum(l_quantity * p_retailprice) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)")
def smv(spark, d):
    m, x = frame(spark, d, "lineitem"), frame(spark, d, "part")
    joined = Frame(m.df.select("l_suppkey", "l_partkey", "l_quantity").join(x.df.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")))
    return _rounded(joined.split("l_suppkey").fold(x=fo.sum_(joined["l_quantity"] * joined["p_retailprice"])), x=4)
