"""cohortlens: customer cohort and lifecycle analytics as lazy Spark DataFrame plans.

Every public operator takes already-loaded star-schema DataFrames
(``customers``, ``orders``, ``products``; see :mod:`cohortlens.sources.schema`)
and returns a lazy DataFrame. Nothing is collected to the driver.
"""

from cohortlens.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
