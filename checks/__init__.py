"""Registered queries over the driver tables, with oracle SQL."""

from checks import files, posts, rebuild, runs  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
