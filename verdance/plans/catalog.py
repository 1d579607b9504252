"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from . import audits, core, reports, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
