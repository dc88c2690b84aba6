"""Imports every module that registers queries."""

from .functions import queries as functions  # noqa: F401
from .operators import diff, dml, graph, order, relational  # noqa: F401
from .plans import certify, diagnostics, migration, procedures, reports, sandbox, sqltext, tsql_queries  # noqa: F401
from .sources import queries as sources, tables  # noqa: F401
from .streaming import events, machines  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
