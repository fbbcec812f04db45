"""Driver-side values as literals, and what a log call becomes on a DataFrame."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Compatibility flags.
FLAGS = {"allowUndefinedProperties": True, "allowNullArithmetic": False, "allowImplicitConversion": True, "strictTypeChecking": False, "allowDynamicProperties": True}


def compatibility_flag(name: str) -> Column:
    """Null for a name that is not a flag."""
    return F.lit(FLAGS.get(name)).cast("boolean")


def env_var(name: str) -> Column:
    """The driver's, as a literal; null where unset."""
    return F.lit(os.environ.get(name)).cast("string")


def env_vars(*allowed: str) -> Column:
    """The driver's variables of the allowed names: what a plan holds, its logs show."""
    pairs = [F.lit(x) for name in sorted(set(allowed)) if name in os.environ for x in (name, os.environ[name])]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def logged(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """`df` unchanged; the aggregates of what went through it are in the observation once an action has run."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen
