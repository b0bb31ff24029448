"""Signing keys: life cycle on the driver, validity and export as DataFrame operations."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import secrets
from dataclasses import asdict, dataclass, fields, replace
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseal.functions import crypto

HMAC, ECDSA = "HMAC-SHA256", "ECDSA-P256"  # fixed values: algorithm names
SCHEMA = "keyid string, algorithm string, created_utc string, expires_utc string, revoked_utc string, active boolean, hmac_secret_b64 string, hmac_fingerprint string, private_key_pem string, public_key_pem string, current boolean"


def now_text() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass(frozen=True)
class Key:
    keyid: str
    algorithm: str
    created_utc: str
    expires_utc: str | None = None
    revoked_utc: str | None = None
    active: bool = True
    hmac_secret_b64: str | None = None
    private_key_pem: str | None = None
    public_key_pem: str | None = None

    def valid_at(self, when: str | None = None) -> bool:
        return self.revoked_utc is None and self.active and (not self.expires_utc or (when or now_text()) < self.expires_utc)

    def to_dict(self, private: bool = False) -> dict:
        out = {k: v for k, v in asdict(self).items() if k not in ("hmac_secret_b64", "private_key_pem", "public_key_pem")}
        if self.public_key_pem:
            out["public_key_pem"] = self.public_key_pem
        if private:
            out |= {k: getattr(self, k) for k in ("hmac_secret_b64", "private_key_pem") if getattr(self, k)}
        elif self.algorithm == HMAC and self.hmac_secret_b64:
            out["hmac_fingerprint"] = hashlib.sha256(base64.b64decode(self.hmac_secret_b64)).hexdigest()[:16]
        return out

    @staticmethod
    def from_dict(d: dict) -> Key:
        return Key(**{f.name: d[f.name] for f in fields(Key) if f.name in d})


class Registry:
    """Keys in the order they came, one of them active for signing; saved whole after each change where a path is given."""

    def __init__(self, path: str | None = None):
        self.path, self.keys, self.active = path, {}, None
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self._fill(json.load(f))

    def _fill(self, data: dict) -> None:
        self.active = data.get("active_keyid")
        for d in data.get("keys", ()):
            self.keys[d["keyid"]] = Key.from_dict(d)

    def _save(self) -> None:
        if self.path:
            with open(self.path, "w", encoding="utf-8") as f:
                json.dump({"active_keyid": self.active, "keys": [k.to_dict(private=True) for k in self.keys.values()]}, f, indent=2)

    def _new(self, keyid: str, algorithm: str, days: int, use: bool, **material) -> Key:
        if keyid in self.keys:
            raise ValueError(f"key {keyid} exists")
        expires = (datetime.now(UTC) + timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ") if days else None
        self.keys[keyid] = key = Key(keyid, algorithm, now_text(), expires, **material)
        if use:
            self.active = keyid
        self._save()
        return key

    def generate_hmac(self, keyid: str, days: int = 90, secret: bytes | None = None, use: bool = True) -> Key:
        return self._new(keyid, HMAC, days, use, hmac_secret_b64=base64.b64encode(secret or secrets.token_bytes(32)).decode())

    def generate_ecdsa(self, keyid: str, days: int = 90, use: bool = True) -> Key:
        if keyid in self.keys:
            raise ValueError(f"key {keyid} exists")
        private, public = crypto.p256_generate()
        return self._new(keyid, ECDSA, days, use, private_key_pem=private, public_key_pem=public)

    def revoke(self, keyid: str) -> None:
        if keyid not in self.keys:
            raise KeyError(keyid)
        self.keys[keyid] = replace(self.keys[keyid], revoked_utc=now_text(), active=False)
        if self.active == keyid:
            self.active = None
        self._save()

    def rotate(self, keyid: str, days: int = 90, algorithm: str = HMAC) -> Key:
        """The new key must be free before the old one is put to rest."""
        if keyid in self.keys:
            raise ValueError(f"key {keyid} exists")
        if self.active:
            self.keys[self.active] = replace(self.keys[self.active], active=False)
        return (self.generate_ecdsa if algorithm == ECDSA else self.generate_hmac)(keyid, days)

    def get(self, keyid: str) -> Key | None:
        return self.keys.get(keyid)

    def get_active(self) -> Key | None:
        return self.keys.get(self.active) if self.active else None

    def get_valid(self, keyid: str) -> Key | None:
        key = self.keys.get(keyid)
        return key if key and key.valid_at() else None

    def list(self) -> list[Key]:
        return list(self.keys.values())

    def export_public(self, path: str | None = None) -> dict:
        data = {"exported_utc": now_text(), "active_keyid": self.active, "keys": [k.to_dict() for k in self.keys.values()]}
        if path:
            with open(path, "w", encoding="utf-8") as f:
                json.dump(data, f, indent=2)
        return data

    @staticmethod
    def from_public(data: dict | str) -> Registry:
        if isinstance(data, str):
            with open(data, encoding="utf-8") as f:
                data = json.load(f)
        out = Registry()
        out._fill(data)
        return out

    def load_secret(self, keyid: str, secret: bytes) -> None:
        """Not saved."""
        key = self.keys.get(keyid)
        if key is None:
            raise KeyError(keyid)
        if key.algorithm != HMAC:
            raise ValueError(f"{keyid} is no {HMAC} key")
        self.keys[keyid] = replace(key, hmac_secret_b64=base64.b64encode(secret).decode())

    def sign(self, keyid: str, data: bytes) -> bytes:
        key = self.get_valid(keyid)
        if key is None:
            raise ValueError(f"{keyid} is unknown or not valid")
        if key.algorithm == HMAC:
            return hmac.digest(base64.b64decode(key.hmac_secret_b64), data, "sha256")
        return crypto.p256_sign(key.private_key_pem, data)

    def verify(self, keyid: str, data: bytes, sig: bytes) -> bool:
        """Expired keys verify; unknown and revoked ones don't."""
        key = self.keys.get(keyid)
        if key is None or key.revoked_utc is not None:
            return False
        if key.algorithm == HMAC:
            return bool(key.hmac_secret_b64) and hmac.compare_digest(hmac.digest(base64.b64decode(key.hmac_secret_b64), data, "sha256"), sig)
        public = key.public_key_pem or (key.private_key_pem and crypto.p256_public(key.private_key_pem))
        return bool(public) and crypto.p256_verify(public, data, sig)

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a key; `current` marks the one to sign with."""
        rows = [(k.keyid, k.algorithm, k.created_utc, k.expires_utc, k.revoked_utc, k.active, k.hmac_secret_b64, None, k.private_key_pem, k.public_key_pem, k.keyid == self.active) for k in self.keys.values()]
        return spark.createDataFrame(rows, SCHEMA)


def is_valid(when: Column | None = None) -> Column:
    """Validity of a key row at a time (text; now if none)."""
    at = F.coalesce(when, F.lit(now_text())) if when is not None else F.lit(now_text())
    fresh = F.col("expires_utc").isNull() | (F.col("expires_utc") == "") | (at < F.col("expires_utc"))
    return F.col("revoked_utc").isNull() & F.coalesce(F.col("active"), F.lit(True)) & fresh


def valid_keys(keys: DataFrame, when: Column | None = None) -> DataFrame:
    return keys.where(is_valid(when))


def public_keys(keys: DataFrame) -> DataFrame:
    """Without secrets; HMAC keys with the first 16 hex digits of the secret's digest."""
    mark = F.when(F.col("algorithm") == HMAC, F.substring(F.sha2(F.unbase64("hmac_secret_b64"), 256), 1, 16))
    return keys.select("keyid", "algorithm", "created_utc", "expires_utc", "revoked_utc", "active", mark.alias("hmac_fingerprint"), "public_key_pem")


#: Registries up to this many rows are sent to all executors; larger ones are joined by shuffle.
BROADCAST_KEYS = 10_000


def signing_material(keys: DataFrame) -> DataFrame:
    """What verification needs, a row a key id; of rows that repeat an id the one created last counts. A private key stands for its public one where that is missing."""

    @F.pandas_udf("string")
    def public_of(pem: pd.Series) -> pd.Series:
        return pem.map(crypto.p256_public, na_action="ignore")

    pem = F.coalesce("public_key_pem", public_of(F.when(F.col("public_key_pem").isNull() & (F.col("algorithm") == ECDSA), F.col("private_key_pem"))))
    made = keys.where("keyid is not null").select("keyid", F.struct("created_utc", "algorithm", "expires_utc", "revoked_utc", F.unbase64("hmac_secret_b64").alias("secret"), pem.alias("pem")).alias("x"))
    return made.groupBy("keyid").agg(F.max("x").alias("x")).select("keyid", "x.algorithm", "x.created_utc", "x.expires_utc", "x.revoked_utc", "x.secret", "x.pem")
