"""Importing this package fills the registry in ``base``."""

from . import analysis, evaluation, events, extras, identity, jobs, motion, roundtrips, series, textual  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
