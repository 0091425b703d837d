"""All queries of this package; importing the operators registers them."""

from . import exact_dedup, language_id, line_dedup, mix_sources, ngram_join, packing, phrase_mining, quality_rules, substring_dedup, token_counts, topk_search, turn_repair, url_filters  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
