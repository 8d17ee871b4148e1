"""Queries of exact derivatives and of fits whose state is a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import dual, models
from lattica.plans import fitting
from lattica.queries import LINES, lines, query, r, table


@query(f"""WITH {LINES}, e AS (SELECT *, exp(0 - x / t1) AS e, exp(0 - x / t2) AS f FROM l)
SELECT l_orderkey, l_linenumber, round(1 - 2 * e, 6) + 0.0 AS recovery_m0, round(0 - 2 * m0 * e * x / (t1 * t1), 6) + 0.0 AS recovery_t1, round(f, 6) AS decay_m0, round(m0 * f * x / (t2 * t2), 4) AS decay_t2 FROM e""")
def model_derivatives(spark, d):
    rec = dual.differentiate(models.inversion_recovery, ["m0", "t1"], ti="x", m0="m0", t1="t1").parts
    dec = dual.differentiate(models.mono_exponential_decay, ["m0", "decay"], time="x", m0="m0", decay="t2").parts
    return lines(spark, d).select("l_orderkey", "l_linenumber", r(rec["m0"]).alias("recovery_m0"), r(rec["t1"]).alias("recovery_t1"), r(dec["m0"]).alias("decay_m0"), r(dec["decay"], 4).alias("decay_t2"))


#: Times of the first four entries of a vector, taken as logarithms of a signal.
_TIMES = (0.0, 1.0, 2.0, 4.0)


@query("""WITH s AS (SELECT vec_id, unnest([0.0, 1.0, 2.0, 4.0])::DOUBLE AS t, unnest(embedding[1:4])::DOUBLE AS v FROM embeddings)
SELECT vec_id, round(0 - regr_slope(v, t), 5) + 0.0 AS rate, round(regr_intercept(v, t), 5) + 0.0 AS log_m0 FROM s GROUP BY vec_id""")
def fit_decay_rates(spark, d):
    """Rate and amplitude of every vector by L-BFGS on the sum of all squared differences of logarithms."""

    def cost(x):
        parts = [(x["log_m0"] - x["rate"] * t - F.col("embedding")[k].cast("double")) ** 2 for k, t in enumerate(_TIMES)]
        return sum(parts[1:], parts[0])

    df = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    got = fitting.lbfgs(df, cost, {"rate": F.lit(0.0), "log_m0": F.lit(0.0)}, max_iterations=20, tolerance=1e-9)
    return got.select("vec_id", r("rate", 5).alias("rate"), r("log_m0", 5).alias("log_m0"))


def _adam_steps(steps: int) -> str:
    out = "s0 AS (SELECT vec_id, embedding[1]::DOUBLE AS a, 0.0::DOUBLE AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM embeddings)"
    for k in range(1, steps + 1):
        out += f""", g{k} AS (SELECT vec_id, a, x, 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * 2 * (x - a) AS m, 0.999::DOUBLE * v + (1 - 0.999::DOUBLE) * 4 * (x - a) * (x - a) AS v FROM s{k - 1}),
        s{k} AS (SELECT vec_id, a, x - 0.01::DOUBLE * (m / (1 - pow(0.9::DOUBLE, {k}))) / (sqrt(v / (1 - pow(0.999::DOUBLE, {k}))) + 1e-8::DOUBLE) AS x, m, v FROM g{k})"""
    return out


@query(f"WITH {_adam_steps(5)} SELECT vec_id, round(x, 5) + 0.0 AS x FROM s5")
def fit_adam_steps(spark, d):
    """Five steps of Adam from zero towards the first entry of every vector."""
    df = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("a"))
    got = fitting.adam(df, lambda x: (x["x"] - F.col("a")) ** 2, {"x": F.lit(0.0)}, max_iterations=5, rate=0.01)
    return got.select("vec_id", r("x", 5).alias("x"))
