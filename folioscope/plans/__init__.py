"""The engine's queries. Importing this package registers them."""

from . import cases, pages, rules  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
