"""All training-data queries, registered by importing their modules."""

from clickcast.llm import (  # noqa: F401
    chunked_bpe,
    conversation_repair,
    cotraining,
    decontaminate,
    language_id,
    license_scan,
    near_dedup,
    packing,
    spelling,
    suffix_dedup,
    url_filter,
    warc,
    winnowing,
)
from clickcast.llm.catalog import ORACLES, QUERIES  # noqa: F401
