"""Aggregate functions of the pattern language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentile_disc(x: Column, p: Column) -> Column:
    """The value at floor(p * (n - 1)) of the sorted values, as a double: not SQL's percentile_disc."""
    return F.sort_array(F.collect_list(x.cast("double")))[F.floor(p * (F.count(x) - 1)).cast("int")]


def _defined(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Null where one of the variances is 0."""

    def guarded(y: Column, x: Column) -> Column:
        both = y.isNotNull() & x.isNotNull()
        flat = (F.var_pop(F.when(both, y)) == 0) | (F.var_pop(F.when(both, x)) == 0)
        return F.when(~flat, f(y, x))

    return guarded


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "collect": F.collect_list, "collect_list": F.collect_list,
    "stdev": F.stddev_samp, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stdevp": F.stddev_pop, "stddev_pop": F.stddev_pop,
    "variance": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop,
    "percentile_disc": percentile_disc, "percentiledisc": percentile_disc,
    "percentile_cont": lambda x, p: F.percentile(x, p), "percentilecont": lambda x, p: F.percentile(x, p),
    "group_concat": lambda x, sep=None: F.array_join(F.sort_array(F.collect_list(x.cast("string"))), sep or " "),
    "listagg": lambda x, sep=None: F.array_join(F.sort_array(F.collect_list(x.cast("string"))), sep or ","),
    # any of the values is right for these; the smallest is the same in every run
    "sample": F.min, "any_value": F.min,
    # rows have no order of their own, so first and last are asked for by a key: first(x, key)
    "first": lambda x, key=None: F.first(x, ignorenulls=True) if key is None else F.min_by(x, F.when(x.isNotNull(), key)),
    "first_value": lambda x, key: F.min_by(x, F.when(x.isNotNull(), key)), "last_value": lambda x, key: F.max_by(x, F.when(x.isNotNull(), key)),
    "map_collect": lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v))),
    "covar_samp": F.covar_samp, "covar_pop": F.covar_pop, "corr": _defined(F.corr),
    "regr_slope": F.regr_slope, "regr_intercept": F.regr_intercept, "regr_r2": _defined(F.regr_r2), "regr_count": F.regr_count,
    "regr_sxx": F.regr_sxx, "regr_syy": F.regr_syy, "regr_sxy": F.regr_sxy, "regr_avgx": F.regr_avgx, "regr_avgy": F.regr_avgy,
}

#: Forms that look at each distinct value once.
DISTINCT: dict[str, Callable[..., Column]] = {
    "count": F.count_distinct, "sum": F.sum_distinct, "collect": F.collect_set, "collect_list": F.collect_set,
    "avg": lambda x: F.sum_distinct(x) / F.count_distinct(x), "min": F.min, "max": F.max,
    "group_concat": lambda x, sep=None: F.array_join(F.sort_array(F.collect_set(x.cast("string"))), sep or " "),
    "listagg": lambda x, sep=None: F.array_join(F.sort_array(F.collect_set(x.cast("string"))), sep or ","),
}
