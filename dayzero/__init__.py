"""Day-zero player analytics on PySpark.

``dayzero.plans`` holds the finished reports, ``dayzero.operators`` the
DataFrame-to-DataFrame building blocks they share, ``dayzero.functions`` the
column expressions and ``dayzero.sources`` the input tables.
"""

from dayzero.session import build_session
from dayzero.sources.tables import Tables

__all__ = ["Tables", "build_session"]
