"""All registered queries of the library's own operators, with the SQL that must give the same rows."""

from volframe.plans import run_queries, volume_queries  # noqa: F401  they register theirs
from volframe.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
