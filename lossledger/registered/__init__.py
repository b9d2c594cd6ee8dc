"""Every operator as a query over the supplied tables, with equivalent SQL."""

from . import (  # noqa: F401
    aggregates,
    credit,
    filters,
    joins,
    matching,
    profiles,
    reports,
    scalars,
    scans,
    search,
    windows,
)
from .base import QUERIES, SQL  # noqa: F401
