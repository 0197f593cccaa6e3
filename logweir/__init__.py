"""logweir: log analytics as Spark jobs.

Raw lines are detected, parsed, ruled, analysed, enriched, mined, reported on and
alerted on as DataFrame operations. Rules and filters become Column expressions.
"""

from logweir.session import build_session, configure

__all__ = ["build_session", "configure"]
