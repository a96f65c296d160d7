"""sondage — a Spark-native engine for versioned survey responses.

Everything is a plain function from DataFrame (plus small driver-side specs)
to DataFrame, built from Spark's own operators so Catalyst can prune, push
down and plan the work.
"""

from .session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
