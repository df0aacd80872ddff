"""All registered queries."""

from cohortloom.plans import (  # noqa: F401
    catalog_analysis,
    catalog_expression,
    catalog_learning,
    catalog_pipeline,
    catalog_relational,
    catalog_sources,
    catalog_stats,
)
from cohortloom.plans.registry import ORACLE, QUERIES  # noqa: F401
