"""Statistics over series: anomalies, correlation and lead-lag, elasticity, deflation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import ContractError
from ..sources.scratch import written
from .ranges import SMALL_GROUP, grouped_medians, hot_groups, medians, with_groups

#: Scales the median absolute deviation to a standard deviation, and what stands for a deviation of 0.
MAD_SCALE, LEAST_MAD = 0.6745, 1e-9


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's r of the rows where both are there; null for fewer than two rows or no variance."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def anomalies(rows: DataFrame, keys: list[str], metric: str = "mom_pct", method: str = "robust", z: float = 2.0, most: int = 20, small: int = SMALL_GROUP) -> DataFrame:
    """Rows whose ``z_score`` is at least ``z`` away from 0, the ``most`` extreme ones of each key, with ``rank``.

    method: ``robust`` scales the distance to the median by the median absolute deviation; ``zscore`` that to the mean by
    the sample deviation, without which a key has none. Keys with fewer than two values have none. A key with a large share
    of all rows, and over ``small`` of them, is never held in one task.
    """
    if method not in ("robust", "zscore"):
        raise ContractError("bad_method", method)
    v = rows.where(F.col(metric).isNotNull())
    if method == "robust":
        v = written(v, "metric")
        middle, hot = grouped_medians(v, keys, metric, "_mid", small)
        v = written(with_groups(v, middle, keys, hot).withColumn("_far", F.abs(F.col(metric) - F.col("_mid"))), "centred")
        spread = medians(v, keys, "_far", "_mad", hot).join(v.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
        v = with_groups(v, spread, keys, hot).drop("_far")
        score = MAD_SCALE * (F.col(metric) - F.col("_mid")) / F.when(F.col("_mad") == 0, LEAST_MAD).otherwise(F.col("_mad"))
    else:
        middle = v.groupBy(*keys).agg(F.avg(metric).alias("_mid"), F.stddev_samp(metric).alias("_mad"), F.count("*").alias("_n"))
        v = with_groups(v, middle, keys, hot_groups(v, keys, small))
        score = F.try_divide(F.col(metric) - F.col("_mid"), F.col("_mad"))
    v = v.where("_n >= 2").withColumn("z_score", score).where(F.abs("z_score") >= z)
    order = W.partitionBy(*keys).orderBy(F.desc(F.abs("z_score")), "date")
    return v.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("_mid", "_mad", "_n")


def paired(a: DataFrame, b: DataFrame, least: int = 2) -> DataFrame:
    """(date, a, b, grain): two series (date, value) on equal dates, or by month with the last value of each if fewer than ``least`` dates meet.

    Both pairings stand in one plan; a count decides between them.
    """
    named = lambda df, name: df.where("value is not null").select("date", F.col("value").alias(name))
    monthly = lambda df, name: df.where("value is not null").groupBy(F.last_day("date").alias("date")).agg(F.max_by("value", "date").alias(name))
    exact = named(a, "a").join(named(b, "b"), "date").withColumn("grain", F.lit("D"))
    months = monthly(a, "a").join(monthly(b, "b"), "date").withColumn("grain", F.lit("M"))
    n = exact.agg(F.count("*")).scalar()
    return exact.where(n >= least).unionByName(months.where(n < least))


def correlation(pairs: DataFrame) -> DataFrame:
    """(n, correlation, grain) of (a, b, grain) rows."""
    return pairs.agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("correlation"), F.max("grain").alias("grain"))


def lead_lag(pairs: DataFrame, max_lag: int = 6) -> DataFrame:
    """(lag, n, correlation, is_best) for lags by position: at ``lag`` k, a[i] meets b[i + k], so k > 0 means that a leads.

    Lags go to max_lag or n - 4, whichever is less, and only from four pairs on. The best one has the largest |r|, rounded
    to 4 places; of equals the smallest |k|, then the negative one.
    """
    order = W.orderBy("date")  # the pairs of two series
    rows = pairs.select("a", "b", F.row_number().over(order).alias("i"), F.count("*").over(W.partitionBy()).alias("n"))
    reach = F.when(F.col("n") >= 4, F.least(F.lit(max_lag), F.col("n") - 4)).otherwise(0)
    left = rows.select("a", "i", F.explode(F.sequence(-reach, reach)).alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    right = rows.select("b", F.col("i").alias("j"))
    out = left.join(right, "j").groupBy("lag").agg(F.count("*").alias("n"), F.round(pearson(F.col("a"), F.col("b")), 4).alias("correlation"))
    best = F.row_number().over(W.orderBy(F.desc_nulls_last(F.abs("correlation")), F.abs("lag"), "lag"))  # a row for each lag
    return out.withColumn("is_best", (best == 1) & F.col("correlation").isNotNull())


def elasticity(dep: DataFrame, indep: DataFrame, lag: int = 0, method: str = "log_log") -> DataFrame:
    """(n, elasticity, r_squared, form, elastic_class, direction) of ``dep`` to ``indep`` (date, value) ``lag`` of its own rows earlier.

    log_log: slope of the logarithms where all values are positive, else slope of the levels times mean x over mean y; arc:
    midpoint elasticity between the first and the last pair. Fewer than three pairs give a null elasticity.
    """
    if method not in ("log_log", "arc"):
        raise ContractError("bad_method", method)
    x = indep.where("value is not null")
    x = x.select("date", F.lag("value", lag).over(W.orderBy("date")).alias("value")) if lag else x  # one series
    p = paired(dep, x, 3)
    y, x = F.col("a"), F.col("b")
    if method == "log_log":
        positive = F.bool_and((x > 0) & (y > 0))
        lx, ly = F.ln(F.when(x > 0, x)), F.ln(F.when(y > 0, y))
        level = F.try_divide(F.regr_slope(y, x) * F.avg(x), F.avg(y))
        value = F.when(positive, F.regr_slope(ly, lx)).otherwise(level)
        fit = F.when(positive, F.when(F.var_pop(ly) == 0, 0.0).otherwise(F.regr_r2(ly, lx))).otherwise(F.when(F.var_pop(y) == 0, 0.0).otherwise(F.regr_r2(y, x)))
        form = F.when(positive, "log_log").otherwise("level")
    else:
        x0, x1, y0, y1 = F.min_by(x, "date"), F.max_by(x, "date"), F.min_by(y, "date"), F.max_by(y, "date")
        dy, dx = F.try_divide(y1 - y0, (y1 + y0) / 2), F.try_divide(x1 - x0, (x1 + x0) / 2)
        value, fit, form = F.coalesce(F.try_divide(dy, dx), F.lit(0.0)), F.lit(1.0), F.lit("arc")
    out = p.agg(F.count("*").alias("n"), value.alias("elasticity"), fit.alias("r_squared"), form.alias("form"))
    out = out.withColumn("elasticity", F.when(F.col("n") >= 3, F.col("elasticity")))
    size = F.abs("elasticity")
    return out.withColumns(
        {
            "elastic_class": F.when(size > 1.2, "elastic").when(size >= 0.8, "unit").when(size.isNotNull(), "inelastic"),
            "direction": F.when(F.col("elasticity") > 0, "positive").when(F.col("elasticity") < 0, "negative").when(size.isNotNull(), "none"),
        }
    )


def deflated(nominal: DataFrame, deflator: DataFrame, base: str | None = None) -> DataFrame:
    """(date, nominal, deflator, real): nominal values at the deflator's level of ``base``, or of the first common date.

    real is nominal * base / deflator, or nominal where the deflator is not positive.
    """
    p = paired(nominal, deflator, 2)
    first = F.min_by("b", "date").over(W.partitionBy())  # the pairs of two series
    at = F.max(F.when(F.col("date") == F.lit(base).cast("date"), F.col("b"))).over(W.partitionBy()) if base else F.lit(None).cast("double")
    rows = p.withColumn("_base", F.coalesce(at, first))
    real = F.when(F.col("b") > 0, F.col("a") * F.col("_base") / F.col("b")).otherwise(F.col("a"))
    return rows.select("date", F.col("a").alias("nominal"), F.col("b").alias("deflator"), real.alias("real"))


def deflation_summary(real: DataFrame) -> DataFrame:
    """(nominal_growth_pct, inflation_pct, real_growth_pct, erosion_pct) between the first and the last date; growths are of values rounded to 2 places."""
    r = real.withColumns({"nominal": F.round("nominal", 2), "real": F.round("real", 2)})
    ends = r.agg(*[f(c, "date").alias(f"{c}_{k}") for c in ("nominal", "deflator", "real") for k, f in (("first", F.min_by), ("last", F.max_by))])
    growth = lambda c: F.try_divide(F.col(f"{c}_last") - F.col(f"{c}_first"), F.col(f"{c}_first")) * 100
    return ends.select(growth("nominal").alias("nominal_growth_pct"), growth("deflator").alias("inflation_pct"), growth("real").alias("real_growth_pct"), (growth("nominal") - growth("real")).alias("erosion_pct"))
