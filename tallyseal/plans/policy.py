"""Canonicalization policy: read once on the driver, compiled into plans."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace

# Section and key names of the policy format, with defaults where a key is missing.
TIMESTAMP_FIELDS = ("timestamp", "created_at", "updated_at", "modified_at", "date", "datetime", "time", "ts")
NON_SUBSTANTIVE_FIELDS = ("timestamp",)
NONCE_FIELDS = ("nonce", "request_id", "trace_id", "x-request-id", "correlation_id", "idempotency_key", "session_id")
SYNONYMS = (("USA", "United States"), ("U.S.", "United States"), ("U.S.A.", "United States"), ("US", "United States"), ("UK", "United Kingdom"), ("U.K.", "United Kingdom"))

DIGESTS = {"SHA-256": 256, "SHA-384": 384, "SHA-512": 512}


@dataclass(frozen=True)
class Policy:
    version: str
    digest: str = "SHA-256"
    output: str = "hex"
    unicode_form: str = "NFC"
    trim: bool = True
    collapse: bool = True
    lower: bool = False
    numbers: bool = True
    remove_null: bool = True
    remove_empty: bool = False
    sort_keys: bool = True
    timestamps: str = "exact"
    granularity: str = "day"
    strip_non_substantive: bool = False
    timestamp_fields: tuple[str, ...] = TIMESTAMP_FIELDS
    non_substantive: tuple[str, ...] = NON_SUBSTANTIVE_FIELDS
    synonyms: tuple[tuple[str, str], ...] = ()
    sort_sets: bool = True
    dedup_sets: bool = False
    nonces: tuple[str, ...] = ()

    def __post_init__(self):
        if self.digest not in DIGESTS:
            raise ValueError(f"digest must be one of {sorted(DIGESTS)}")
        if self.output not in ("hex", "base64"):
            raise ValueError("output must be hex or base64")
        if self.unicode_form not in ("NFC", "NFD", "NFKC", "NFKD"):
            raise ValueError("unknown Unicode form")

    @property
    def bits(self) -> int:
        return DIGESTS[self.digest]

    def with_(self, **changes) -> Policy:
        return replace(self, **changes)

    def rules(self) -> list[tuple[str, str]]:
        """Synonyms, longest variant first; of variants that fold to one, the last counts; equal lengths keep their order."""
        folded: dict[str, str] = {}
        for variant, name in self.synonyms:
            folded[variant.lower()] = name
        return sorted(folded.items(), key=lambda x: -len(x[0]))

    def drops(self, name: str) -> bool:
        return name.lower() in {n.lower() for n in self.nonces}

    def timestamp_action(self, name: str) -> str:
        """keep, strip or bucket, for string values under a normalized field name."""
        key = name.lower()
        if self.strip_non_substantive and key in {n.lower() for n in self.non_substantive}:
            return "strip"
        if key not in {n.lower() for n in self.timestamp_fields}:
            return "keep"
        return self.timestamps if self.timestamps in ("strip", "bucket") else "keep"


#: The general-purpose policy.
DEFAULT = Policy("1.0.0", timestamps="bucket", strip_non_substantive=True, synonyms=SYNONYMS, nonces=NONCE_FIELDS)

#: section -> key -> field of Policy
_KEYS = {
    "hash": {"algorithm": "digest", "output_encoding": "output"},
    "encoding": {"unicode_normalization": "unicode_form"},
    "string_normalization": {"trim_whitespace": "trim", "collapse_internal_whitespace": "collapse", "lowercase_strings": "lower"},
    "json_normalization": {"sort_keys": "sort_keys", "remove_null_fields": "remove_null", "remove_empty_strings": "remove_empty", "numeric_normalization": "numbers"},
    "timestamp_normalization": {"mode": "timestamps", "bucket_granularity": "granularity", "ignore_if_marked_non_substantive": "strip_non_substantive", "timestamp_fields": "timestamp_fields", "non_substantive_fields": "non_substantive"},
    "list_normalization": {"sort_sets": "sort_sets", "deduplicate_sets": "dedup_sets"},
}
#: Keys that describe and change nothing.
_SILENT = {"implemented", "policy_description", "charset", "strip_bom", "numeric_format", "timezone_normalization"}
_SILENT_SECTIONS = {"binary_normalization", "signing", "audit"}


def from_toml(text: str) -> Policy:
    data = tomllib.loads(text)
    fields: dict = {"version": data.pop("policy_version")}
    for section, body in data.items():
        if section in _SILENT or section in _SILENT_SECTIONS:
            continue
        if section == "synonyms":
            if body.get("enabled", False):
                fields["synonyms"] = tuple(body.get("mappings", {}).items())
        elif section == "nonces":
            if body.get("exclude_from_canonical_form", False):
                fields["nonces"] = tuple(body.get("excluded_fields", ()))
        elif section in _KEYS:
            for key, value in body.items():
                if key in _KEYS[section]:
                    fields[_KEYS[section][key]] = tuple(value) if isinstance(value, list) else value
                elif key not in _SILENT:
                    raise ValueError(f"unknown policy key {section}.{key}")
        else:
            raise ValueError(f"unknown policy section {section}")
    return Policy(**fields)


def load(path: str) -> Policy:
    with open(path, encoding="utf-8") as f:
        return from_toml(f.read())
