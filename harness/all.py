"""Importing this module registers every query."""

from . import urls_queries  # noqa: F401
from . import audit_queries  # noqa: F401
from . import run_queries  # noqa: F401
from . import store_queries  # noqa: F401
from . import cluster_queries  # noqa: F401
from . import measured_queries  # noqa: F401
