"""ledgerlens: business-analytics operators expressed as Spark DataFrame plans.

Every public operator is a plain function ``DataFrame (+ column names) -> DataFrame``.
Work runs on the executors; the driver only inspects schemas and, where an
operator changes the column list, reads a one-row summary.
"""

__version__ = "0.1.0"
