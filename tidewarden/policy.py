"""Scoring policy: a nested mapping with dotted access. Values enter plans as literals, so Catalyst folds them."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

# Weights, bands, points and thresholds of the scoring rules.
DEFAULT: dict[str, Any] = {
    "weights": {"ti": 0.40, "dga": 0.35, "lexical": 0.25, "tunnel": 0.15, "behavioral": 0.10},
    "bands": [["SAFE", "ALLOW", 0, 29], ["SUSPICIOUS", "MONITOR", 30, 69], ["MALICIOUS", "BLOCK", 70, 100]],
    "intel": {"malicious": 95, "suspicious": 60, "trusted": 0, "parent_factor": 0.9, "trusted_confidence": 0.9, "trusted_parent_confidence": 0.85},
    "dga": {
        "bigram": 1.1, "coverage": 2.0, "coverage_mid": 0.5, "digits": 3.0, "digits_mid": 0.10, "bias": -2.2, "z_low": -3.0, "z_high": 6.0,
        "full_length": 10, "high": 0.8, "moderate": 0.5, "word_composed": None, "long": 8, "short": 5, "confidence": [0.8, 0.55, 0.3],
    },
    "tunnel": {
        "long_subdomain": [40, 28], "long_label": [30, 24], "entropy": [3.8, 22], "entropy_min_length": 30, "many_labels": [5, 14],
        "encoded_payload": 26, "high_capacity_record": 12, "record_types": ["TXT", "NULL", "CNAME", "MX", "SRV", "ANY"], "confidence": [0.35, 0.6, 0.85],
    },
    "behavioral": {
        "min_events": 3, "burst": [20, 26], "fanout": [8, 30], "nxdomain": [0.5, 22], "nxdomain_min_events": 5, "blocked": [3, 20],
        "confidence": [0.5, 0.01, 0.85], "window_minutes": 60,
    },
    "lexical": {
        "ENTROPY_HIGH": [3.6, 18], "ENTROPY_VERY_HIGH": [4.1, 12], "ENTROPY_NORMALIZED_HIGH": [0.82, 10], "normalized_min_length": 12,
        "DIGIT_RATIO_HIGH": [0.20, 14], "DIGIT_RATIO_VERY_HIGH": [0.40, 10], "LENGTH_LONG": [25, 8], "LENGTH_VERY_LONG": [40, 8],
        "HYPHEN_MANY": [3, 10], "SUBDOMAIN_DEEP": [4, 10], "CONSONANT_RUN_LONG": [5, 12], "VOWEL_RATIO_LOW": [0.20, 12], "vowel_min_length": 8,
        "NO_DICTIONARY_WORDS": [0.20, 14], "words_min_length": 10, "SUSPICIOUS_TLD": 20, "SUSPICIOUS_KEYWORD": [16, 4, 20],
        "BRAND_IMPERSONATION": 25, "BRAND_SUBSTRING": 10, "PUNYCODE": 15, "tld_medium": 0.7, "keyword_medium": 0.6, "confidence": [0.85, 0.45], "short_label": 6,
    },
    "fusion": {
        "set_aside": 60, "ti_floor": 85, "ti_floor_confidence": 0.85, "brand_floor": 60, "corroboration": [70, 8], "tld_dga": [0.8, 5],
        "single": [70, 2, 70], "trusted_ceiling": 25, "least_move": 0.01,
    },
}


class Policy:
    def __init__(self, values: dict[str, Any] | None = None, overrides: dict[str, Any] | None = None):
        self.values = copy.deepcopy(values or DEFAULT)
        for path, value in (overrides or {}).items():
            *parents, last = path.split(".")
            node = self.values
            for name in parents:
                node = node.setdefault(name, {})
            node[last] = value

    @classmethod
    def load(cls, path: str) -> Policy:
        return cls(json.loads(Path(path).read_text()))

    def get(self, path: str, default: Any = None) -> Any:
        node: Any = self.values
        for name in path.split("."):
            if not isinstance(node, dict) or name not in node:
                return default
            node = node[name]
        return node

    def public(self) -> dict[str, Any]:
        """Without keys that begin with an underscore."""

        def strip(x: Any) -> Any:
            return {k: strip(v) for k, v in x.items() if not k.startswith("_")} if isinstance(x, dict) else x

        return strip(self.values)


POLICY = Policy()
