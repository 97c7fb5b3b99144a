"""Queries of maps, predicates, casts, texts and complex numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as v
from ..functions.complexes import Complex
from ..functions.vec import Vec, lift
from ..operators import apply as ap
from .registry import frame, query

#: Tables with NA, NaN, infinities and zeros, made from order keys; the SQL twins spell the same rules.
EDGE = "CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE WHEN 4 THEN 0.0 WHEN 5 THEN -value ELSE value END"
KLEENE_A = "CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END"
KLEENE_B = "CASE (event_id // 3) % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END"


def edges(spark, d):
    f = frame(spark, d, "events", "event_id")
    k = F.col("event_id") % 7
    x = F.when(k == 0, None).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k == 3, F.lit(float("-inf"))).when(k == 4, 0.0).when(k == 5, -F.col("value")).otherwise(F.col("value"))
    return f.with_(x=Vec(x, "double"))


def kleene(spark, d):
    f = frame(spark, d, "events", "event_id")
    three = lambda k: Vec(F.when(k == 1, True).when(k == 2, False), "logical")
    return f.with_(a=three(F.col("event_id") % 3), b=three(F.floor(F.col("event_id") / 3) % 3))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS n, l_orderkey + l_linenumber AS isum, l_extendedprice * (1 - l_discount) + l_tax AS dsum, -l_quantity AS neg, l_quantity AS pos, l_partkey - l_suppkey * 3 AS idiff, -l_partkey AS ineg FROM lineitem")
def map_arith(spark, d):
    f = frame(spark, d, "lineitem")
    return f.select("l_orderkey", n=f["l_linenumber"], isum=f["l_orderkey"] + f["l_linenumber"], dsum=f["l_extendedprice"] * (1 - f["l_discount"]) + f["l_tax"], neg=-f["l_quantity"], pos=+f["l_quantity"], idiff=f["l_partkey"] - f["l_suppkey"] * 3, ineg=-f["l_partkey"])


@query("SELECT event_id, value / (event_id % 3 - 1)::DOUBLE AS q, (event_id % 2)::DOUBLE / (event_id % 3)::DOUBLE AS z, event_id / 4.0::DOUBLE AS half FROM events")
def map_div_ieee(spark, d):
    f = frame(spark, d, "events")
    e = f["event_id"]
    return f.select("event_id", q=f["value"] / (e % 3 - 1), z=(e % 2) / (e % 3), half=e / 4)


@query("SELECT event_id, CASE WHEN event_id % 5 - 2 <> 0 THEN trunc((event_id - 5000) / (event_id % 5 - 2)::DOUBLE)::BIGINT END AS q FROM events")
def map_idiv_int(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", q=(f["event_id"] - 5000) // (f["event_id"] % 5 - 2))


@query("SELECT event_id, floor((value - 50) / 7.5) AS q, floor(value / -3.0) AS r FROM events")
def map_idiv_dbl(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", q=(f["value"] - 50) // 7.5, r=f["value"] // -3.0)


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (event_id - 5000) % (event_id % 5) END AS r FROM events")
def map_mod_int(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", r=(f["event_id"] - 5000) % (f["event_id"] % 5))


@query("SELECT event_id, round((value - 50) - floor((value - 50) / 7.5) * 7.5, 6) AS r, round(value - floor(value / -3.0) * -3.0, 6) AS s FROM events")
def map_mod_dbl(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", r=v.round_((f["value"] - 50) % 7.5, 6), s=v.round_(f["value"] % -3.0, 6))


@query("SELECT p_partkey, 1.0::DOUBLE AS p0, p_retailprice AS p1, p_retailprice * p_retailprice AS p2, sqrt(p_retailprice) AS ph, 1 / p_retailprice AS pi, round(pow(p_size, 3.0), 3) AS p3 FROM part")
def map_pow(spark, d):
    f = frame(spark, d, "part")
    x = f["p_retailprice"]
    return f.select("p_partkey", p0=x**0, p1=x**1, p2=x**2, ph=x**0.5, pi=x**-1, p3=v.round_(f["p_size"] ** 3.0, 3))


@query("SELECT c_custkey, abs(c_acctbal) AS a, sign(c_acctbal)::DOUBLE AS s, abs(c_custkey - 700) AS ia FROM customer")
def map_abs_sign(spark, d):
    f = frame(spark, d, "customer")
    return f.select("c_custkey", a=abs(f["c_acctbal"]), s=v.sign(f["c_acctbal"]), ia=abs(f["c_custkey"] - 700))


@query("SELECT event_id, sqrt(value) AS q, round(exp(-value / 50), 9) AS e, round(ln(value + 1), 9) AS l FROM events")
def map_sqrt_exp_log(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", q=v.sqrt(f["value"]), e=v.round_(v.exp(-f["value"] / 50), 9), l=v.round_(v.log(f["value"] + 1), 9))


@query("SELECT event_id, CASE WHEN x IS NULL THEN NULL WHEN isnan(x) THEN x WHEN x > 0 THEN CASE WHEN isinf(x) THEN x ELSE round(ln(x), 9) END WHEN x = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS l FROM (SELECT event_id, " + EDGE + " AS x FROM events)")
def map_log_edge(spark, d):
    f = edges(spark, d)
    log = v.log(f["x"])
    return f.select("event_id", l=v.ifelse(v.is_finite(log), v.round_(v.ifelse(v.is_finite(log), log, 0.0), 9), log))


@query("SELECT event_id, round(cos(value), 9) AS c, round(sin(value), 9) AS s, round(tan(value / 1000), 9) AS t FROM events")
def map_trig(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", c=v.round_(v.cos(f["value"]), 9), s=v.round_(v.sin(f["value"]), 9), t=v.round_(v.tan(f["value"] / 1000), 9))


@query("SELECT l_orderkey, l_linenumber, round(acos(l_discount), 9) AS ac, round(asin(l_discount), 9) AS si, round(atan(l_quantity), 9) AS ta FROM lineitem")
def map_invtrig(spark, d):
    f = frame(spark, d, "lineitem")
    return f.select("l_orderkey", "l_linenumber", ac=v.round_(v.acos(f["l_discount"]), 9), si=v.round_(v.asin(f["l_discount"]), 9), ta=v.round_(v.atan(f["l_quantity"]), 9))


@query("SELECT c_custkey, round(atan2(c_acctbal, c_custkey), 9) AS a, round(sqrt(c_acctbal * c_acctbal + c_custkey * c_custkey), 6) AS h FROM customer")
def map_atan2_hypot(spark, d):
    f = frame(spark, d, "customer")
    return f.select("c_custkey", a=v.round_(v.atan2(f["c_acctbal"], f["c_custkey"]), 9), h=v.round_(v.hypot(f["c_acctbal"], f["c_custkey"]), 6))


@query("SELECT event_id, floor(x) AS f, ceil(x) AS c, trunc(x) AS t FROM (SELECT event_id, " + EDGE + " AS x FROM events)")
def map_floor_ceil_trunc(spark, d):
    f = edges(spark, d)
    signed = lambda y: v.ifelse(y == 0, f["x"] * 0.0, y)  # noqa: E731  the algebra's zeros are positive, the SQL's have the sign of x
    return f.select("event_id", f=signed(v.floor(f["x"])), c=signed(v.ceiling(f["x"])), t=signed(v.trunc(f["x"])))


@query("SELECT event_id, round(value, 1) AS r1, round(value) AS r0, sign(value) * floor(abs(value) * pow(10, event_id % 3) + 0.5) / pow(10, event_id % 3) AS rd FROM events")
def map_round(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", r1=v.round_(f["value"], 1), r0=v.round_(f["value"], 0), rd=v.round_(f["value"], f["event_id"] % 3))


@query("SELECT event_id, round(CASE WHEN value = 0 THEN 0 ELSE sign(value) * floor(abs(value) * pow(10, 3 - ceil(log10(abs(CASE WHEN value <> 0 THEN value END)))) + 0.5) / pow(10, 3 - ceil(log10(abs(CASE WHEN value <> 0 THEN value END)))) END, 9) AS s FROM events")
def map_signif(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", s=v.round_(v.signif(f["value"], 3), 9))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN x IS NULL THEN NULL ELSE least(x, l_tax) END AS lo, CASE WHEN x IS NULL THEN NULL ELSE greatest(x, l_tax) END AS hi, greatest(l_partkey, l_suppkey) AS ihi FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_discount END AS x FROM lineitem)")
def map_pmin_pmax(spark, d):
    f = frame(spark, d, "lineitem")
    x = v.ifelse(f["l_linenumber"] == 1, Vec(F.lit(None).cast("double"), "double"), f["l_discount"])
    return f.select("l_orderkey", "l_linenumber", lo=v.pmin(x, f["l_tax"]), hi=v.pmax(x, f["l_tax"]), ihi=v.pmax(f["l_partkey"], f["l_suppkey"]))


@query("SELECT event_id, CASE WHEN x > 10 THEN 1.5 ELSE event_id::DOUBLE END AS y FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS x FROM events)")
def map_ifelse(spark, d):
    f = frame(spark, d, "events")
    x = Vec(F.when(F.col("event_id") % 4 != 0, F.col("value")), "double")
    return f.select("event_id", y=v.ifelse(x > 10, 1.5, f["event_id"]))


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END * 2 + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END)::BIGINT AS code FROM lineitem")
def map_nested_ifelse(spark, d):
    f = frame(spark, d, "lineitem")
    a = v.ifelse(f["l_returnflag"] == "A", 0, v.ifelse(f["l_returnflag"] == "N", 1, 2))
    return f.select("l_orderkey", "l_linenumber", code=a * 2 + v.ifelse(f["l_linestatus"] == "F", 0, 1))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 2 ELSE 0 END::BIGINT AS s FROM customer")
def map_switch(spark, d):
    f = frame(spark, d, "customer")
    return f.select("c_custkey", s=v.switch(f["c_mktsegment"], {"BUILDING": 1, "MACHINERY": None, "HOUSEHOLD": 2}, 0))


@query(
    "SELECT event_id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN NULL ELSE trunc(x)::BIGINT END AS di, CASE WHEN isnan(x) THEN NULL ELSE x <> 0 END AS dl, "
    "CASE event_id % 3 WHEN 0 THEN 'TRUE' ELSE 'FALSE' END AS lc, (event_id % 3 = 0)::BIGINT AS li, (event_id % 3 = 0)::BIGINT::DOUBLE AS ld, "
    "CASE event_id % 4 WHEN 0 THEN 12 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE -7 END::BIGINT AS ci, CASE event_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 1.5 WHEN 2 THEN NULL ELSE -7 END::DOUBLE AS cd, "
    "CASE event_id % 4 WHEN 3 THEN NULL END::BOOLEAN AS cl FROM (SELECT event_id, " + EDGE + " AS x FROM events)"
)
def map_casts(spark, d):
    f = edges(spark, d)
    k = F.col("event_id") % 4
    text = Vec(F.when(k == 0, "12").when(k == 1, "1.5").when(k == 2, "abc").otherwise("-7"), "character")
    third = f["event_id"] % 3 == 0
    whole = Vec(F.when(k == 1, F.lit(None)).otherwise(text.col), "character")
    return f.select("event_id", di=v.as_integer(f["x"]), dl=v.as_logical(f["x"]), lc=v.as_character(third), li=v.as_integer(third), ld=v.as_double(third), ci=v.as_integer(whole), cd=v.as_double(text), cl=v.as_logical(text))


@query("SELECT event_id, value + CASE event_id % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 4.0 ELSE 8.0 END AS s, event_id + CASE event_id % 2 WHEN 0 THEN 1 ELSE 2 END AS i FROM events")
def map_recycle(spark, d):
    f = frame(spark, d, "events")
    return f.select("event_id", s=f["value"] + v.recycle([2.0, 4.0, 8.0], f["event_id"]), i=f["event_id"] + v.recycle([1, 2], f["event_id"]))


@query("SELECT l_orderkey, l_linenumber, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_partkey < l_suppkey AS lt, l_discount <= l_tax AS le, l_discount > l_tax AS gt, l_quantity >= l_linenumber AS ge FROM lineitem")
def pred_compare_num(spark, d):
    f = frame(spark, d, "lineitem")
    q, s, t = f["l_quantity"], f["l_discount"], f["l_tax"]
    return f.select("l_orderkey", "l_linenumber", eq=q == 10, ne=q != 10, lt=f["l_partkey"] < f["l_suppkey"], le=s <= t, gt=s > t, ge=q >= f["l_linenumber"])


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AS eq, c_mktsegment < 'FURNITURE' AS lt, c_name >= 'Customer#00' AS ge, c_custkey::VARCHAR > c_mktsegment AS mixed FROM customer")
def pred_compare_str(spark, d):
    f = frame(spark, d, "customer")
    m = f["c_mktsegment"]
    return f.select("c_custkey", eq=m == "BUILDING", lt=m < "FURNITURE", ge=f["c_name"] >= "Customer#00", mixed=f["c_custkey"] > m)


@query(f"SELECT event_id, a AND b AS \"and\", a OR b AS \"or\", NOT a AS \"not\" FROM (SELECT event_id, {KLEENE_A} AS a, {KLEENE_B} AS b FROM events)")
def pred_logic_kleene(spark, d):
    f = kleene(spark, d)
    return f.df.select("event_id", (f["a"] & f["b"]).alias("and"), (f["a"] | f["b"]).alias("or"), (~f["a"]).alias("not"))


@query("SELECT event_id, x IS NULL AS na, coalesce(isnan(x), false) AS nan, coalesce(isfinite(x), false) AS fin, coalesce(isinf(x), false) AS inf FROM (SELECT event_id, " + EDGE + " AS x FROM events)")
def pred_isna_nan_inf(spark, d):
    f = edges(spark, d)
    return f.select("event_id", na=v.is_na(f["x"]), nan=v.is_nan(f["x"]), fin=v.is_finite(f["x"]), inf=v.is_infinite(f["x"]))


@query("SELECT event_id, CASE WHEN x IS NOT NULL THEN value END AS value FROM (SELECT event_id, value, CASE WHEN event_id % 5 > 0 THEN value END AS x FROM events) WHERE x > 20 OR x IS NULL")
def pred_na_filter(spark, d):
    f = frame(spark, d, "events", "event_id")
    x = Vec(F.when(F.col("event_id") % 5 > 0, F.col("value")), "double")
    return f.filter(x > 20, keep_na=True).df.select("event_id", "value")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_name END, 'NA') || '/' || c_mktsegment || '/' || c_custkey::VARCHAR AS p FROM customer")
def paste_sep(spark, d):
    f = frame(spark, d, "customer")
    name = Vec(F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")), "character")
    return f.select("c_custkey", p=v.paste(name, f["c_mktsegment"], f["c_custkey"], sep="/"))


@query("SELECT c_custkey, coalesce(length(x), 2)::BIGINT AS n, coalesce(length(x), 2) > 0 AS z FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS x FROM customer)")
def str_nchar(spark, d):
    f = frame(spark, d, "customer")
    x = Vec(F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")), "character")
    return f.select("c_custkey", n=v.nchar(x), z=v.nzchar(x))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS sr, l_discount - 2.0 AS si, l_quantity * l_tax - l_discount * -2.0 AS pr, l_quantity * -2.0 + l_discount * l_tax AS pi FROM lineitem")
def complex_arith(spark, d):
    f = frame(spark, d, "lineitem")
    a, b = Complex(f["l_quantity"], f["l_discount"]), Complex(f["l_tax"], lift(-2.0))
    s, p = a + b, a * b
    return f.select("l_orderkey", "l_linenumber", sr=s.re, si=s.im, pr=p.re, pi=p.im)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity * l_tax + l_discount * -2.0) / (l_tax * l_tax + 4), 9) AS re, round((l_discount * l_tax - l_quantity * -2.0) / (l_tax * l_tax + 4), 9) AS im FROM lineitem")
def complex_div(spark, d):
    f = frame(spark, d, "lineitem")
    q = Complex(f["l_quantity"], f["l_discount"]) / Complex(f["l_tax"], lift(-2.0))
    return f.select("l_orderkey", "l_linenumber", re=v.round_(q.re, 9), im=v.round_(q.im, 9))


@query("SELECT vec_id, list_sum(list_transform(embedding[1:8], lambda e: round(e::DOUBLE * 2 + 1, 6))) AS s FROM embeddings")
def lapply_closure(spark, d):
    df = frame(spark, d, "embeddings").df
    doubled = ap.lapply(F.slice("embedding", 1, 8), lambda e: F.round(e.cast("double") * 2 + 1, 6))
    return df.select("vec_id", F.aggregate(doubled, F.lit(0.0), lambda a, e: a + e).alias("s"))


@query("SELECT vec_id, list_sum(list_transform(range(1, 7), lambda i: round(embedding[i]::DOUBLE * (CASE (i - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END), 6))) AS s FROM embeddings")
def mapply_two(spark, d):
    df = frame(spark, d, "embeddings").df
    made = ap.mapply(lambda a, b: F.round(a.cast("double") * b, 6), F.slice("embedding", 1, 6), F.array(F.lit(1.0), F.lit(10.0), F.lit(100.0)))
    return df.select("vec_id", F.aggregate(made, F.lit(0.0), lambda a, e: a + e).alias("s"))


@query("SELECT event_id, value * 2 + 1 AS y FROM events")
def udf_pandas(spark, d):
    return frame(spark, d, "events").df.select("event_id", ap.pandas_map(lambda x: x * 2 + 1, "double")("value").alias("y"))


@query("SELECT p_partkey, p_retailprice AS x, copy FROM (SELECT p_partkey, p_retailprice, unnest(range(1, p_partkey % 3 + 1)) AS copy FROM part)")
def udtf_rep(spark, d):
    part = frame(spark, d, "part").df
    spark.udtf.register("vecframe_repeat", ap.Repeat)
    part.createOrReplaceTempView("vecframe_part")
    return spark.sql("SELECT p_partkey, r.x, r.copy FROM vecframe_part, LATERAL vecframe_repeat(p_retailprice, CAST(p_partkey % 3 AS INT)) r")
