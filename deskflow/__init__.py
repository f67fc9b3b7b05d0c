"""deskflow: support-ticket triage analytics on Spark.

Public entry points (DataFrame in, DataFrame out):

    from deskflow import get_session, score_tickets, score_tickets_model
    spark = get_session()
    scored = score_tickets(tickets_df)                  # rule path (#42)
    routed = route_departments(tickets_df)              # keyword router (#37)

Everything is also reachable as named queries: ``deskflow.plans.queries()``.
"""

from __future__ import annotations

from .session import checkpoint_dir, get_session  # noqa: F401


def __getattr__(name):
    # Operators import pyspark.ml lazily; keep ``import deskflow`` light.
    from .operators import evaluate, profile, reports, score, tickets, vectors
    from .streaming import stream
    for mod in (score, tickets, reports, profile, vectors, evaluate, stream):
        if hasattr(mod, name):
            return getattr(mod, name)
    raise AttributeError(name)
