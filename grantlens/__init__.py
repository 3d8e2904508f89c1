"""grantlens: access-governance analytics as Spark DataFrame jobs.

Every job is a pure function ``DataFrames (+ explicit clock) -> DataFrame``;
only :mod:`grantlens.sources.sinks` and :mod:`grantlens.plans.daily` touch
storage.
"""

__all__ = ["__version__"]
__version__ = "0.1.0"
