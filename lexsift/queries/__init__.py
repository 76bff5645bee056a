"""Named queries over the test tables, each with SQL that gives the same rows."""

from . import candidates, derive, hints, index, maintenance, search, stats  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
