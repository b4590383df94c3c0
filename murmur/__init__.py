"""murmur: Spark-native social-listening analytics.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
transformation. Nothing here collects row data to the driver; small scalar
results (thresholds, coefficients) travel as one-row frames that are joined
back, so the whole computation stays inside Spark's planner.
"""

from murmur.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
