"""Log triage analytics on Spark: DataFrame in, DataFrame out."""

from faultline.session import local_session

__all__ = ["local_session"]
