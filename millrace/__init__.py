"""millrace: relational, streaming, pattern, graph and learning operators on PySpark."""

from millrace.session import build_session
from millrace.sources.tables import Tables

__all__ = ["Tables", "build_session"]
