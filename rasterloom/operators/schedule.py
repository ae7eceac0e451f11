"""Diffusion schedules and sampling steps as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def linear_betas(spark: SparkSession, steps: int) -> DataFrame:
    lo, hi = 1000.0 / steps * 1e-4, 1000.0 / steps * 2e-2
    return spark.range(steps).select(F.col("id").alias("t"), (F.lit(lo) + F.col("id") * ((hi - lo) / max(1, steps - 1))).alias("beta"))


def cosine_betas(spark: SparkSession, steps: int, most: float = 0.999) -> DataFrame:
    bar = lambda t: F.pow(F.cos((t / float(steps) + 0.008) / 1.008 * (math.pi / 2)), 2)
    t = F.col("id")
    return spark.range(steps).select(t.alias("t"), F.least(1.0 - bar(t + 1) / bar(t), F.lit(most)).alias("beta"))


def with_alphas(betas: DataFrame) -> DataFrame:
    """Add alpha_bar (running product, in exact order) and the one before it (1 at the start)."""
    run = F.expr(
        "aggregate(array_sort(collect_list(struct(t, beta))), cast(array() as array<struct<t:bigint,beta:double,bar:double>>),"
        " (acc, s) -> concat(acc, array(struct(s.t as t, s.beta as beta, (if(size(acc) = 0, 1D, acc[size(acc) - 1].bar) * (1D - s.beta)) as bar))))"
    )
    rows = betas.agg(run.alias("r")).select(F.explode("r").alias("s"), "r")
    before = F.expr("if(s.t = 0, 1D, r[cast(s.t - 1 as int)].bar)")
    return rows.select("s.t", "s.beta", F.col("s.bar").alias("alpha_bar"), before.alias("alpha_bar_prev"))


def posterior(schedule: DataFrame) -> DataFrame:
    """DDPM posterior: coefficients of x0 and x_t, variance, clipped log variance."""
    b, ab, pr = F.col("beta"), F.col("alpha_bar"), F.col("alpha_bar_prev")
    var = b * (1.0 - pr) / (1.0 - ab)
    first = schedule.where("t = 1").select((F.col("beta") * (1.0 - F.col("alpha_bar_prev")) / (1.0 - F.col("alpha_bar"))).alias("v1"))
    out = schedule.withColumn("coef_x0", b * F.sqrt(pr) / (1.0 - ab)).withColumn("coef_xt", (1.0 - pr) * F.sqrt(1.0 - b) / (1.0 - ab)).withColumn("variance", var)
    return out.join(F.broadcast(first)).withColumn("log_variance", F.ln(F.when(F.col("t") == 0, F.col("v1")).otherwise(F.col("variance")))).drop("v1")


def ddim_pairs(spark: SparkSession, total: int, steps: int) -> DataFrame:
    """(i, t, t_prev), latest first; if steps do not divide the total the top of the schedule is skipped."""
    jump = total // steps
    return spark.range(steps).select(F.col("id").alias("i"), ((steps - F.col("id")) * jump).alias("t"), ((steps - 1 - F.col("id")) * jump).alias("t_prev"))


def forward(x: Column, noise: Column, alpha_bar: Column) -> Column:
    return F.sqrt(alpha_bar) * x + F.sqrt(1.0 - alpha_bar) * noise


def predict_x0(x: Column, eps: Column, alpha_bar: Column) -> Column:
    return F.sqrt(1.0 / alpha_bar) * x - F.sqrt(1.0 / alpha_bar - 1.0) * eps


def predict_eps(x: Column, x0: Column, alpha_bar: Column) -> Column:
    return (F.sqrt(1.0 / alpha_bar) * x - x0) / F.sqrt(1.0 / alpha_bar - 1.0)


def ddim_step(x: Column, eps: Column, alpha_bar: Column, previous: Column, eta: float = 0.0, noise: Column | None = None) -> Column:
    """x at the earlier time; noise counts only with eta above 0."""
    x0 = predict_x0(x, eps, alpha_bar)
    again = predict_eps(x, x0, alpha_bar)
    sigma = eta * F.sqrt((1.0 - previous) / (1.0 - alpha_bar)) * F.sqrt(1.0 - alpha_bar / previous)
    out = F.sqrt(previous) * x0 + F.sqrt(F.greatest(1.0 - previous - sigma * sigma, F.lit(0.0))) * again
    return out if noise is None else out + sigma * noise


def constrained(x0: Column, replacement: Column, mask: Column, convex: float = 1.0) -> Column:
    """Where known, mix the replacement into the estimate."""
    return F.when(mask, convex * replacement + (1.0 - convex) * x0).otherwise(x0)


def guidance(cond: Column, uncond: Column, strength: float = 3.0) -> Column:
    """Classifier-free guidance; no strength, no unconditional part."""
    return cond if strength <= 0 else (1.0 + strength) * cond - strength * uncond


def fill_hidden(value: Column, visible: Column, noise: Column) -> Column:
    return F.when(visible, value).otherwise(noise)


def bin_centres(widths: DataFrame, group: str, least: float, most: float) -> DataFrame:
    """``widths(group, k, w)`` -> centres of bins whose normalised widths fill [least, most]."""
    from pyspark.sql import Window as W

    total = F.sum("w").over(W.partitionBy(group))
    upto = F.sum("w").over(W.partitionBy(group).orderBy("k"))
    edge = lambda s: least + (most - least) * s / total
    return widths.select(group, "k", ((edge(upto) + edge(upto - F.col("w"))) / 2).alias("centre"))


def sinusoid(t: Column, dim: int, longest: float = 10000.0) -> Column:
    """Cosines, then sines, of t at dim/2 falling frequencies."""
    half = dim // 2
    angle = lambda k: t * F.exp(-math.log(longest) * k / half)
    ks = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(ks, lambda k: F.cos(angle(k))), F.transform(ks, lambda k: F.sin(angle(k))))


def log_binomial(p: Column, classes: int, temperature: float = 1.0) -> Column:
    """Softmax of log binomial(k; n-1, p) / temperature with Stirling's factorial."""
    n = classes - 1
    stirling = lambda a: a * F.ln(a + 1e-7)
    eps = 1e-4
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    logit = lambda k: (stirling(F.lit(float(n))) - stirling(k.cast("double")) - stirling(F.lit(float(n)) - k + 1e-7) + k * F.ln(q) + (n - k) * F.ln(1.0 - q)) / temperature
    logits = F.transform(F.sequence(F.lit(0), F.lit(n)), logit)
    raised = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
    return F.transform(raised, lambda v: v / total)


def attractor(centre: Column, points: Column, alpha: float = 300.0, gamma: int = 2, kind: str = "exp", mean: bool = True) -> Column:
    """The centre moved towards each attractor point, by exponential or inverse decay."""
    pull = lambda d: F.exp(-alpha * F.pow(F.abs(d), gamma)) * d if kind == "exp" else d / (1.0 + alpha * F.pow(d, gamma))
    total = F.aggregate(points, F.lit(0.0), lambda a, q: a + pull(q - centre))
    return centre + (total / F.size(points) if mean else total)


def lookup(rows: DataFrame, table: DataFrame, step: str) -> DataFrame:
    """Rows with the schedule's columns at their own step; the table has one row a step."""
    table = table.withColumnRenamed("t", "__t")
    return rows.join(F.broadcast(table), rows[step] == F.col("__t")).drop("__t")


def ddpm_step(x: Column, eps: Column, noise: Column, step: str, clip: bool = False, of: Callable[[str], Column] = F.col) -> Column:
    """x at the step before, of rows that :func:`lookup` has given the posterior's columns; no noise at step 0."""
    x0 = predict_x0(x, eps, of("alpha_bar"))
    if clip:
        x0 = F.greatest(F.least(x0, F.lit(1.0)), F.lit(-1.0))
    return of("coef_x0") * x0 + of("coef_xt") * x + F.when(of(step) > 0, F.exp(0.5 * of("log_variance")) * noise).otherwise(0.0)


def ddim_steps(schedule: DataFrame, total: int, steps: int) -> DataFrame:
    """One row: ``steps``, an array of (t, alpha_bar, previous) in sampling order, of :func:`with_alphas` over ``total`` steps.

    The model sees t, one less than the pair's; before the first step nothing is noise.
    """
    bar = schedule.select((F.col("t") + 1).alias("__t"), "alpha_bar")
    pairs = ddim_pairs(schedule.sparkSession, total, steps)
    pairs = pairs.join(F.broadcast(bar), F.col("t") == F.col("__t")).drop("__t")
    pairs = pairs.join(F.broadcast(bar.withColumnRenamed("alpha_bar", "previous")), F.col("t_prev") == F.col("__t"), "left")
    one = F.struct("i", (F.col("t") - 1).alias("t"), "alpha_bar", F.coalesce("previous", F.lit(1.0)).alias("previous"))
    return pairs.agg(F.array_sort(F.collect_list(one)).alias("steps"))


def ddim_sample(x: Column, steps: Column, model: Callable[[Column, Column], Column], eta: float = 0.0, noise: Callable[[Column], Column] | None = None) -> Column:
    """x after all ``steps`` of :func:`ddim_steps`, folded within the row; ``model(x, t)`` predicts the noise."""
    return F.aggregate(
        steps, x, lambda v, s: ddim_step(v, model(v, s["t"]), s["alpha_bar"], s["previous"], eta, None if noise is None else noise(s["t"]))
    )


def ddpm_steps(schedule: DataFrame) -> DataFrame:
    """One row: ``steps``, the posterior's rows from the last step to the first, of :func:`with_alphas`."""
    names = ["alpha_bar", "coef_x0", "coef_xt", "log_variance"]
    rows = posterior(schedule).select((-F.col("t")).alias("turn"), "t", *names)
    return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("steps"))


def ddpm_sample(x: Column, steps: Column, model: Callable[[Column, Column], Column], noise: Callable[[Column], Column], clip: bool = False) -> Column:
    """x after all ``steps`` of :func:`ddpm_steps`, folded within the row; ``model(x, t)`` predicts the noise, ``noise(t)`` is fresh."""
    return F.aggregate(steps, x, lambda v, s: ddpm_step(v, model(v, s["t"]), noise(s["t"]), "t", clip, lambda n: s[n]))


def sorted_centres(centres: Column, least: float, most: float) -> Column:
    """Bin centres in rising order within bounds."""
    return F.transform(F.array_sort(centres), lambda c: F.greatest(F.least(c, F.lit(most)), F.lit(least)))
