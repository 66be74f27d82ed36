"""Queries over the tables and the SQL that each is held against."""

from . import further as _further  # noqa: F401  adds its queries to the catalogue, as do the next three
from . import more as _more  # noqa: F401
from . import planes as _planes  # noqa: F401
from . import wider as _wider  # noqa: F401
from .catalogue import QUERIES as QUERIES
from .sql import ORACLES as ORACLES
