"""Named queries over the driver tables, each with the SQL that states the same result."""

from studyspark.catalog import (  # noqa: F401
    charting,
    comparing,
    describing,
    deriving,
    modelling,
    quality,
    reporting,
    writing,
)
from studyspark.catalog.base import REGISTRY  # noqa: F401
