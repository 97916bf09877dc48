"""sheafline: DataFrame operators for labelled, categorised text corpora on Spark."""

from sheafline.session import build_session

__all__ = ["build_session"]
