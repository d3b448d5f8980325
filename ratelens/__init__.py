"""ratelens: outcome-rate analytics on wide tables, written as Spark DataFrame jobs.

Sub-packages
------------
sources    driver tables, the ``fact`` view, CSV scan/sink, model bundles
functions  column expressions (rounding, formats, bins, tiers, rule lists)
operators  DataFrame -> DataFrame operators (rates, stats, scans, features, models, evaluation)
plans      the composed analyses and the registry used by ``__spark_entry__``
"""

from ratelens.roles import Roles, FACT_ROLES, HR_ROLES
from ratelens.session import get_spark, checkpoint_dir

__all__ = ["Roles", "FACT_ROLES", "HR_ROLES", "get_spark", "checkpoint_dir"]
