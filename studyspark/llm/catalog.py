"""All text queries; importing this module registers them."""

from __future__ import annotations

from studyspark.llm import (  # noqa: F401
    collocations,
    decontam,
    html,
    langid,
    licenses,
    linededup,
    merkle,
    mixing,
    neardup,
    quality,
    repetition,
    secretscan,
    toxicity,
)
from studyspark.llm.base import REGISTRY  # noqa: F401
