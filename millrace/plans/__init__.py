"""Importing the plan modules registers their queries."""

from millrace.plans import aggregates, files, joins, lasting, rows, sequences, streams  # noqa: F401
from millrace.plans.registry import CHECKS, QUERIES  # noqa: F401
