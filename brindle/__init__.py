"""brindle: an analytics engine expressed as Spark DataFrame and SQL plans."""

from brindle.session import build_session

__all__ = ["build_session"]
