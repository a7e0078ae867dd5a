"""All registered queries."""

from ledgerloom.plans import catalog_ledger  # noqa: F401
from ledgerloom.plans import catalog_extract  # noqa: F401
from ledgerloom.plans import catalog_sources  # noqa: F401
from ledgerloom.plans.registry import QUERIES, SQL  # noqa: F401
