"""Named queries (Spark builders + DuckDB oracle SQL)."""

from .registry import ORACLE, QUERIES, register  # noqa: F401
from . import q_scoring  # noqa: F401,E402  (registers on import)
from . import q_results  # noqa: F401,E402
from . import q_text  # noqa: F401,E402
from . import q_stream  # noqa: F401,E402
