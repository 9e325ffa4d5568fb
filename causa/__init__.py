"""Case-document analytics on Spark: corpus jobs from page text to checked, compared and scored records."""

import os

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark) -> None:
    """Let Python workers on this machine import the package wherever the driver was started.

    On a cluster the package is sent with --py-files; a path that isn't there does no harm.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
