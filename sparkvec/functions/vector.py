"""Column expressions over `array<float>` vectors and packed sparse codes.

A packed code is `array<struct<feature_id int, weight float>>`, strongest
feature first. All arithmetic is done in double.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EPS = 1e-8
CODE_TYPE = "array<struct<feature_id:int,weight:float>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _doubles(c) -> Column:
    return _col(c).cast("array<double>")


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v, mode: str = "add") -> Column:
    """`x / (|x| + eps)` for mode "add", `x / max(|x|, eps)` for mode "clamp"."""
    if mode not in ("add", "clamp"):
        raise ValueError(f"unknown normalisation mode {mode!r}")
    n = norm(v)
    denominator = n + F.lit(EPS) if mode == "add" else F.greatest(n, F.lit(EPS))
    # bind the norm once per row instead of once per element
    return F.element_at(
        F.transform(F.array(denominator), lambda s: F.transform(_doubles(v), lambda x: x / s)), 1
    ).cast("array<float>")


def cosine(a, b) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def l2_distance(a, b) -> Column:
    return F.sqrt(_total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def truncate_dim(v, m: int) -> Column:
    return F.slice(_col(v), 1, m)


def features(code) -> Column:
    return F.transform(_col(code), lambda x: x["feature_id"])


def positive_weights(code) -> Column:
    return F.filter(_col(code), lambda x: x["weight"] > 0)


def nonzero_weights(code) -> Column:
    return F.filter(_col(code), lambda x: x["weight"] != 0)


def jaccard(code_a, code_b) -> Column:
    a, b = features(code_a), features(code_b)
    return F.size(F.array_intersect(a, b)) / (F.size(F.array_union(a, b)) + F.lit(EPS))


def code_norm(code) -> Column:
    return F.sqrt(F.aggregate(
        _col(code), F.lit(0.0),
        lambda acc, x: acc + x["weight"].cast("double") * x["weight"].cast("double")))


def sparse_dot(code_a, code_b) -> Column:
    lookup = F.map_from_entries(F.transform(
        _col(code_b), lambda x: F.struct(x["feature_id"], x["weight"].cast("double"))))
    return F.aggregate(
        _col(code_a), F.lit(0.0),
        lambda acc, x: acc + x["weight"].cast("double")
        * F.coalesce(F.try_element_at(lookup, x["feature_id"]), F.lit(0.0)))


def sparse_cosine(code_a, code_b) -> Column:
    return sparse_dot(code_a, code_b) / (
        F.greatest(code_norm(code_a), F.lit(EPS)) * F.greatest(code_norm(code_b), F.lit(EPS)))


def keep_top(code, k) -> Column:
    """Codes are nested: the first k entries of a code are the code for that k."""
    return F.slice(_col(code), 1, k)


def raw_topk(v, k: int) -> Column:
    """k largest entries by absolute value with their sign, zeros dropped."""
    if k <= 0:
        raise ValueError("k must be positive")
    pairs = F.transform(_col(v), lambda x, i: F.struct(
        (-F.abs(x)).alias("key"), i.cast("int").alias("feature_id"),
        x.cast("float").alias("weight")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(
        F.filter(best, lambda x: x["weight"] != 0),
        lambda x: F.struct(x["feature_id"].alias("feature_id"), x["weight"].alias("weight")))


# Bodies of the SQL functions; `a`, `b`, `v` are array<double>.
_SQL_FUNCTIONS = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vec_norm(v ARRAY<DOUBLE>)":
        "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))",
    "vec_l2_normalize(v ARRAY<DOUBLE>)":
        "transform(v, x -> x / (sqrt(aggregate(v, 0D, (s, y) -> s + y * y)) + 1e-8D))",
    "vec_l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)":
        "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>)":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
        " / (greatest(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)), 1e-8D)"
        " * greatest(sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 1e-8D))",
    "feature_jaccard(a ARRAY<INT>, b ARRAY<INT>)":
        "size(array_intersect(a, b)) / (size(array_union(a, b)) + 1e-8D)",
    "code_dot(a ARRAY<STRUCT<feature_id: INT, weight: FLOAT>>,"
    " b ARRAY<STRUCT<feature_id: INT, weight: FLOAT>>)":
        "aggregate(a, 0D, (s, x) -> s + double(x.weight) * aggregate("
        "filter(b, y -> y.feature_id = x.feature_id), 0D, (t, y) -> t + double(y.weight)))",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Make the vector functions callable from `spark.sql`."""
    names = []
    for signature, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(", 1)[0])
    return names


def publish(runs: dict, prefix: str = "run") -> list[str]:
    """Make rankings (name -> DataFrame) queryable as temporary views."""
    for name, df in runs.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in runs]
