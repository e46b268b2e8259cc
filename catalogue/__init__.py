"""The queries by group."""

from catalogue import cleaning, modelling, profiling, scoring, serving  # noqa: F401
from catalogue.registry import ORACLES, QUERIES  # noqa: F401
