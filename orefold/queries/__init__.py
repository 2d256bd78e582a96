"""One query for each operator, with the SQL that says the same."""

from . import base, changes, gold, mapping, profiling, quality, sources  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
