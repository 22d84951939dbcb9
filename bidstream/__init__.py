"""Online-auction analytics as Spark DataFrame and Structured Streaming jobs."""

from bidstream.params import Params
from bidstream.session import configure
from bidstream.sources.tables import Tables, from_warehouse

__all__ = ["Params", "Tables", "configure", "from_warehouse"]
