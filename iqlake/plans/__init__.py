"""Registered queries over the driver's tables."""

from . import metric_queries as metric_queries
from . import report_queries as report_queries
from . import sample_queries as sample_queries
from . import similarity_queries as similarity_queries
from . import storage_queries as storage_queries
from .registry import ORACLE as ORACLE
from .registry import QUERIES as QUERIES
