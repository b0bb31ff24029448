"""Registered queries over keys and signed receipts of all formats, valid and damaged, with their DuckDB statements."""

from __future__ import annotations

import base64
import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.functions import crypto
from tallyseal.functions.encoding import py_pae
from tallyseal.operators import keys as K
from tallyseal.operators import receipts, verify
from tallyseal.plans import catalog

#: Public test material, no secrets.
P256_TEST = int.from_bytes(hashlib.sha256(b"tallyseal test curve key").digest()) >> 8
SEED = bytes(range(32))
FAR, PAST = "2099-01-01T00:00:00Z", "2024-01-01T00:00:00Z"


def _curve_keys(spark) -> DataFrame:
    rows = []
    for keyid, secret in (("first", P256_TEST), ("second", P256_TEST + 1)):
        private, public = crypto.p256_generate(secret)
        rows.append((keyid, K.ECDSA, PAST, FAR, None, True, None, None, private, public, keyid == "first"))
    return spark.createDataFrame(rows, K.SCHEMA)


def ecdsa_receipts(spark, d):
    """Receipts signed by the table's current ECDSA key, a third relabelled as another key's and a third as an unknown one's, verified by public keys only."""
    keys = _curve_keys(spark)
    s = catalog._spread(catalog._t(spark, d, "supplier", "s_suppkey", "s_name")).withColumn("canonical_form", F.col("s_name")).withColumn("frozen_hash", F.sha2("s_name", 256))
    signed = receipts.sign(s, keys, receipt_id=F.col("s_suppkey").cast("string"), when=F.lit(catalog.WHEN))
    who, e = F.element_at(F.array(*map(F.lit, ("first", "second", "nobody"))), (F.col("s_suppkey") % 3 + 1).cast("int")), F.col("envelope")
    moved = signed.withColumn("envelope", F.struct(e["payloadType"].alias("payloadType"), e["payload"].alias("payload"), F.array(F.struct(who.alias("keyid"), e["signatures"][0]["sig"].alias("sig"))).alias("signatures")))
    return receipts.verify(moved, keys.withColumn("private_key_pem", F.lit(None).cast("string")), id_col="s_suppkey").select("s_suppkey", "valid", "key_algorithm", "reason")


_ECDSA_SQL = """
select s_suppkey, k = 0 as valid, case when k = 0 then 'ECDSA-P256' end as key_algorithm,
       case k when 0 then 'Signature valid' when 1 then 'second: signature mismatch' else 'nobody: not found in registry' end as reason
from (select s_suppkey, s_suppkey % 3 as k from supplier)
"""


def _bend(text: str) -> str:
    """The text with another last hex digit."""
    return text[:-1] + ("0" if text[-1] != "0" else "1")


def _envelope(name: str, text: str, namespace: str = verify.NAMESPACE) -> dict:
    domain = f"{name}:v1"
    d = dict.fromkeys(verify.REQUIRED, "x") | {
        "envelope_version": "1", "receipt_id": "sha256:" + hashlib.sha256(name.encode()).hexdigest(), "receipt_type": "witness", "timestamp_utc": catalog.WHEN, "signature_algorithm": "Ed25519",
        "canonical_payload": text, "payload_hash": "sha256:" + hashlib.sha256(text.encode()).hexdigest(), "signing_domain": domain,
        "signer_public_key": crypto.ed25519_public(SEED).hex(), "extensions": {namespace: {"receipt_type": "witness"}},
    }
    return d | {"signature": crypto.ed25519_sign(SEED, f"{domain}\n{text}".encode()).hex()}


def _receipt(k: int, name: str) -> str:
    """One receipt: format by k % 4; by k // 4 % 3 whole, with another signature, or with another body."""
    key, damage, body = crypto.ed25519_public(SEED).hex(), k // 4 % 3, json.dumps({"name": name, "k": k}, sort_keys=True)
    match k % 4:
        case 0:
            kind, data = verify.DSSE_TYPE, body.encode()
            sig = crypto.ed25519_sign(SEED, py_pae(kind, data))
            sig = bytes([sig[0] ^ 1]) + sig[1:] if damage == 1 else sig
            data = data + b" " if damage == 2 else data
            return json.dumps({"payloadType": kind, "payload": base64.b64encode(data).decode(), "signatures": [{"keyid": "k", "sig": base64.b64encode(sig).decode()}]})
        case 1:
            d = _envelope(name, body)
            change = {"canonical_payload": body + " "}
        case 2:
            d = {"receipt_type": "evaluation", "io_integrity_state": "ok", "n": k}
            d |= {"signature": crypto.ed25519_sign(SEED, verify.canonical_bytes(d)).hex(), "signer": key, "payload_hash": "a" * 64, "receipt_coord": "seal:" + hashlib.sha256(name.encode()).hexdigest()[:32]}
            change = {"n": k + 1}
        case _:
            d = {"canon_version": 1, "n": k}
            d |= {"signature": crypto.ed25519_sign(SEED, verify.canonical_bytes(d)).hex(), "signer": key, "payload_hash": "a" * 64}
            change = {"n": k + 1}
    return json.dumps(d | ({"signature": _bend(d["signature"])} if damage == 1 else change if damage == 2 else {}))


@F.pandas_udf(T.StringType())
def _receipts(k: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_receipt(int(a), b) for a, b in zip(k, name, strict=True)], dtype=object)


def receipt_report(spark, d):
    """Every check of signed receipts of the four formats against a given key; two thirds are damaged."""
    r = catalog._spread(catalog._t(spark, d, "supplier", "s_suppkey", "s_name")).select("s_suppkey", _receipts("s_suppkey", "s_name").alias("receipt"), F.lit(crypto.ed25519_public(SEED).hex()).alias("key"))
    out, c = verify.report(r, id_col="s_suppkey", key_col="key"), F.col("checks")
    return out.select(
        "s_suppkey", "format", "receipt_type", "key_source", F.coalesce(c["signature"], c["dsse_signature"]).alias("signature"), F.coalesce(c["payload_hash"], c["payload_hash_format"], c["payload_hash_present"]).alias("payload_hash"),
        F.coalesce(c["payload_type"], c["envelope_structure"], c["coordinate_format"], c["canon_version"]).alias("shape"), F.size("errors").alias("errors"), F.coalesce(F.col("claims")["io_integrity_state"], F.lit("-")).alias("io_state"), "valid",
    )


_REPORT_SQL = """
select s_suppkey, case f when 0 then 'dsse' when 1 then 'envelope_v1' when 2 then 'core' else 'legacy' end as format,
       case f when 1 then 'witness' when 2 then 'evaluation' else 'unknown' end as receipt_type, 'explicit' as key_source,
       g = 0 as signature, case f when 0 then null when 1 then g < 2 else true end as payload_hash, true as shape, 0::int as errors,
       case f when 2 then 'ok' else '-' end as io_state, g = 0 as valid
from (select s_suppkey, s_suppkey % 4 as f, (s_suppkey // 4) % 3 as g from supplier)
"""


def _mutations(name: str) -> list[tuple[str, str]]:
    """A signed envelope, and what must not pass for it."""
    e = _envelope(name, json.dumps({"name": name, "n": 1}))
    text = e["canonical_payload"]
    made = {
        "none": {}, "payload": {"canonical_payload": text[:-2] + "X}"}, "domain": {"signing_domain": "other:v1"}, "signature": {"signature": _bend(e["signature"])},
        "empty_payload": {"canonical_payload": ""}, "null_payload": {"canonical_payload": None}, "null_signature": {"signature": None},
    }
    legacy = {"coord": "sha256:abc123", "receipt_coord": "receipt:sha256:abc123", "canon_version": 1, "signer": e["signer_public_key"], "signature": "deadbeef", "payload_hash": "abcd1234" * 4}
    rows = [(k, json.dumps(e | change)) for k, change in made.items()]
    return [*rows, ("no_version", json.dumps({k: v for k, v in e.items() if k != "envelope_version"})), ("legacy", json.dumps(legacy))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("mutation", T.StringType()), T.StructField("receipt", T.StringType())])))
def _mutated(name: pd.Series) -> pd.Series:
    return pd.Series([[{"mutation": k, "receipt": r} for k, r in _mutations(x)] for x in name], dtype=object)


def envelope_mutations(spark, d):
    """Of each region's signed envelope and its mutations: what each check says."""
    r = catalog._t(spark, d, "region", "r_name").select("r_name", F.inline(_mutated("r_name"))).select(F.concat_ws("/", "r_name", "mutation").alias("case"), "receipt")
    out, c = verify.report(r, id_col="case"), F.col("checks")
    return out.select("case", "format", c["signature"].alias("signature"), F.coalesce(c["envelope_structure"], F.lit(False)).alias("structure"), F.coalesce(c["payload_hash"], F.lit(False)).alias("payload_hash"), "valid")


_MUTATIONS_SQL = """
select r_name || '/' || m as case, case when m in ('no_version', 'legacy') then 'legacy' else 'envelope_v1' end as format, m = 'none' as signature,
       m in ('none', 'payload', 'domain', 'signature') as structure, m in ('none', 'domain', 'signature', 'null_signature') as payload_hash, m = 'none' as valid
from region, (values ('none'), ('payload'), ('domain'), ('signature'), ('empty_payload'), ('null_payload'), ('null_signature'), ('no_version'), ('legacy')) t(m)
"""


def _hmac_sql() -> str:
    """Nested SHA-256 with the pads of the test key."""
    kind = receipts.PAYLOAD_TYPE
    inner, outer = ("".join(f"\\x{b ^ x:02X}" for b in catalog.TEST_KEY.ljust(64, b"\0")) for x in (0x36, 0x5C))
    cf = "sha256('cf' || o_custkey)"  # the canonical form's digest is the frozen hash here
    payload = f"'{{\"canonical_form_hash\":\"' || {cf} || '\",\"frozen_hash\":\"' || {cf} || '\",\"hash_algorithm\":\"SHA-256\",\"policy_version\":\"1.0.0\",\"receipt_id\":\"id' || o_orderkey || '\",\"timestamp_utc\":\"{catalog.WHEN}\"}}'"
    return f"""
select o_orderkey, translate(rtrim(to_base64(unhex(sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode('DSSEv1 {len(kind)} {kind} ' || strlen(p) || ' ' || p)))))), '='), '+/', '-_') as sig
from (select o_orderkey, {payload} as p from orders)
"""


QUERIES = {
    "hmac_receipts": (catalog.hmac_receipts, _hmac_sql()),
    "ecdsa_receipts": (ecdsa_receipts, _ECDSA_SQL),
    "receipt_report": (receipt_report, _REPORT_SQL),
    "envelope_mutations": (envelope_mutations, _MUTATIONS_SQL),
}
