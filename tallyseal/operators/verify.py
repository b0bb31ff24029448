"""Independent verification of four receipt formats, one row a receipt.

Receipts are open JSON objects, so an Arrow UDF unpacks each into fixed columns
(strings only where the JSON has strings); every check is then a Column expression.
"""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.functions import crypto
from tallyseal.functions.encoding import py_pae
from tallyseal.functions.schemaless import compact

# Fixed values of the receipt formats.
EXCLUDED = ("payload_hash", "receipt_coord", "signature", "signature_algorithm", "signer", "signer_fingerprint")
REQUIRED = ("receipt_id", "timestamp_utc", "object_id", "payload_hash", "canonical_payload", "signature", "signing_domain", "signer_public_key", "signer_fingerprint")
RECEIPT_TYPES = ("witness", "settlement", "refusal", "attestation", "identity", "delegation", "acceptance", "invocation", "evaluation", "emission", "certificate", "recognition", "suppression", "evidence", "retrieval", "corroboration", "challenge", "challenge_response", "instruction", "output")
CLAIMS = ("closure_integrity_state", "closure_integrity_score", "io_integrity_state", "io_integrity_score", "evaluator_coord", "evaluator_role")
DSSE_TYPE = "application/vnd.tallyseal.receipt.v1+json"
NAMESPACE = "tallyseal"
_STANDARD = str.maketrans("-_", "+/")


def parse_coordinate(c: Column) -> Column:
    """struct(format, hash, valid): two tags with 32 hex digits, one with 64, or bare digits; lower case only."""
    kind = (
        F.when(F.rlike(c, F.lit(r"^seal:[0-9a-f]{32}\z")), "seal").when(F.rlike(c, F.lit(r"^obligation:[0-9a-f]{32}\z")), "obligation")
        .when(F.rlike(c, F.lit(r"^sha256:[0-9a-f]{64}\z")), "sha256").when(F.rlike(c, F.lit(r"^(?:[0-9a-f]{32}|[0-9a-f]{64})\z")), "bare_hex").otherwise("unknown")
    )
    text = F.coalesce(c, F.lit(""))
    return F.struct(kind.alias("format"), F.when(kind.isin("seal", "obligation", "sha256"), F.substring_index(text, ":", -1)).otherwise(text).alias("hash"), (kind != "unknown").alias("valid"))


def coordinate_valid(c: Column) -> Column:
    return parse_coordinate(c)["valid"]


def envelope_hash_valid(payload: Column, tagged: Column) -> Column:
    return F.coalesce(F.concat(F.lit("sha256:"), F.sha2(payload, 256)) == tagged, F.lit(False))


def structure_errors(at) -> Column:
    """Errors of an envelope's fields; at(name) is the column of a field that is null unless it is a string."""
    missing = [F.when(F.coalesce(at(f), F.lit("")) == "", F.lit(f"no {f}")) for f in REQUIRED]
    return F.array_compact(F.array(*missing, F.when(~at("signature_algorithm").eqNullSafe(F.lit("Ed25519")), F.lit("signature_algorithm is not Ed25519")), F.when(~F.coalesce(at("receipt_type").isin(*RECEIPT_TYPES), F.lit(False)), F.lit("no known receipt_type"))))


def unwrap(data):
    """The receipt inside a response, by three rules in order."""
    inner = data.get("receipt")
    if "receipt" in data and "demo" in data:
        return inner
    if isinstance(inner, dict) and (inner.get("envelope_version") == "1" or _is_core(inner)):
        return inner
    return inner if "receipt" in data and "signature" not in data else data


def _is_core(d: dict) -> bool:
    c = d.get("receipt_coord", "")
    return isinstance(c, str) and c.startswith("seal:")


def _envelope(d: dict):
    return d.get("dsse_envelope", d)


def detect(d: dict) -> str:
    """dsse before envelope_v1 before core before legacy."""
    e = _envelope(d)
    if isinstance(e, dict) and {"payloadType", "payload", "signatures"} <= e.keys():
        return "dsse"
    return "envelope_v1" if d.get("envelope_version") == "1" else "core" if _is_core(d) else "legacy"


def canonical_bytes(d: dict) -> bytes:
    return compact({k: v for k, v in d.items() if k not in EXCLUDED}).encode()


def b64_any(text: str) -> bytes:
    """Either alphabet; padding beyond what is needed does no harm."""
    return base64.b64decode(text.translate(_STANDARD) + "===")


def _hex(x) -> bytes | None:
    try:
        return bytes.fromhex(x) if isinstance(x, str) else None
    except ValueError:
        return None


STRINGS = ("receipt_id", "timestamp_utc", "object_id", "payload_hash", "canonical_payload", "signature", "signing_domain", "signer_public_key", "signer_fingerprint", "signature_algorithm", "receipt_type", "signer", "receipt_coord")
_S, _B = T.StringType(), T.BinaryType()
_KINDS = {"format": _S, "message": _B, "sigs": T.ArrayType(_B), "payload_type": _S, "canon_one": T.BooleanType(), "own_key": _S, "label": _S, "type": _S, "signed_at": _S, "namespace_error": _S, "keyid": _S, "claims": T.MapType(_S, _S)}
UNPACKED = T.StructType([T.StructField(k, t) for k, t in (_KINDS | dict.fromkeys(STRINGS, _S)).items()])


def _claims(d) -> dict:
    return {k: v if isinstance(v, str) else json.dumps(v) for k in CLAIMS if isinstance(d, dict) and k in d for v in [d[k]]}


def unpack(text: str, namespace: str = NAMESPACE) -> dict | None:
    try:
        d = unwrap(json.loads(text))
    except (ValueError, AttributeError, RecursionError):
        return None
    if not isinstance(d, dict):
        return None
    out = dict.fromkeys(UNPACKED.names) | {k: d[k] for k in STRINGS if isinstance(d.get(k), str)}
    out |= {"format": detect(d), "sigs": [], "claims": {}, "canon_one": type(d.get("canon_version")) is int and d["canon_version"] == 1}
    shown, payload = d, d
    if out["format"] == "dsse":
        e = _envelope(d)
        out["payload_type"] = e["payloadType"] if isinstance(e["payloadType"], str) else None
        sigs = e["signatures"] if isinstance(e["signatures"], list) else []
        out["keyid"] = sigs[0].get("keyid", "") if sigs and isinstance(sigs[0], dict) else ""
        payload = {}
        try:
            data = b64_any(e["payload"])
            out["message"] = py_pae(e["payloadType"], data)
            for s in sigs:  # a signature that can't be read ends the list
                one = b64_any(s["sig"])
                if len(one) != 64:
                    break
                out["sigs"].append(one)
        except (ValueError, KeyError, TypeError, AttributeError):
            pass
        try:
            payload = json.loads(b64_any(e["payload"]))
            payload = payload if isinstance(payload, dict) else {}
        except (ValueError, TypeError, AttributeError):
            pass
        out |= {"label": payload.get("receipt_coord", out["keyid"] or "unknown"), "signed_at": payload.get("issued_at", payload.get("timestamp_utc", "unknown")), "type": payload.get("receipt_type", "unknown")}
        out |= {k: str(out[k]) for k in ("label", "signed_at", "type")}
    else:
        sig = _hex(out["signature"])
        out["sigs"] = [sig] if sig and len(sig) == 64 else []
        if out["format"] == "envelope_v1":
            text_, domain = out["canonical_payload"], out["signing_domain"] or ""
            out["message"] = None if text_ is None else ((domain if not domain or domain.endswith("\n") else domain + "\n") + text_).encode("utf-8", "surrogatepass")
            out["own_key"], out["label"] = out["signer_public_key"], out["receipt_id"] or "unknown"
            inner = (d.get("extensions") if isinstance(d.get("extensions"), dict) else {}).get(namespace, {})
            if not isinstance(inner, dict):
                out["namespace_error"] = f"extensions.{namespace} is no object"
            elif not {"spatial_action", "receipt_type"} & inner.keys():
                out["namespace_error"] = f"extensions.{namespace} has neither spatial_action nor receipt_type"
            try:
                payload = json.loads(text_ or "{}")
            except ValueError:
                payload = {}
        else:
            out["message"], out["own_key"], out["label"] = canonical_bytes(d), out["signer"], out["receipt_coord"] or "unknown"
            payload = d if out["format"] == "core" else {}
        out |= {"type": shown.get("receipt_type") if isinstance(shown.get("receipt_type"), str) else "unknown", "signed_at": out["timestamp_utc"] or "unknown"}
    out["claims"] = _claims(payload)
    return out


def _unpack_column(c: Column, namespace: str) -> Column:
    @F.pandas_udf(UNPACKED)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x and unpack(x, namespace) or dict.fromkeys(UNPACKED.names) for x in s], columns=UNPACKED.names, dtype=object)

    return run(c)


@F.pandas_udf(T.BooleanType())
def _any_signature(key: pd.Series, message: pd.Series, sigs: pd.Series) -> pd.Series:
    """All signatures of a batch together: a key met often gets a table."""
    each = [(n, bytes(k), bytes(m), bytes(x)) for n, (k, m, s) in enumerate(zip(key, message, sigs, strict=True)) if k is not None and m is not None and s is not None for x in s]
    good = crypto.ed25519_verify_batch(*([e[k] for e in each] for k in (1, 2, 3)))
    right = {e[0] for e, ok in zip(each, good, strict=True) if ok}
    return pd.Series([n in right for n in range(len(key))], dtype=bool)


def unpacked(df: DataFrame, text_col: str, namespace: str = NAMESPACE) -> DataFrame:
    return df.withColumn("r", _unpack_column(F.col(text_col), namespace))


def report(df: DataFrame, text_col: str = "receipt", *, id_col: str = "id", key_col: str | None = None, namespace: str = NAMESPACE, dsse_type: str = DSSE_TYPE) -> DataFrame:
    """Checks of each receipt by its format, and whether all hold. key_col: hex public key to trust; without one the receipt's own (a DSSE receipt has none)."""
    cols = [F.col(id_col), F.col(text_col).alias("_text"), (F.col(key_col) if key_col else F.lit(None).cast("string")).alias("_given")]
    d = unpacked(df.select(*cols), "_text", namespace)
    r = F.col("r")
    d = d.withColumn("_key", F.coalesce(F.nullif("_given", F.lit("")), r["own_key"]))
    hexed = F.when(F.rlike("_key", F.lit("^[0-9a-fA-F]{64}$")), F.unhex("_key"))
    d = d.withColumn("_sig", F.coalesce(_any_signature(hexed, r["message"], r["sigs"]), F.lit(False)))
    coord, rid = parse_coordinate(r["receipt_coord"]), parse_coordinate(r["receipt_id"])
    errors = F.array_compact(F.concat(structure_errors(lambda k: r[k]), F.array(r["namespace_error"])))
    hash_there, own = coordinate_valid(r["payload_hash"]), F.coalesce

    def checks(**c: Column) -> Column:
        return F.map_from_arrays(F.array(*map(F.lit, c)), F.array(*[own(x, F.lit(False)) for x in c.values()]))

    envelope = checks(envelope_structure=F.size(errors) == 0, signature=F.col("_sig"), payload_hash=envelope_hash_valid(r["canonical_payload"], r["payload_hash"]), signer_key=r["signer_public_key"] == F.col("_key"))
    envelope = F.when(own(r["receipt_id"], F.lit("")) != "", F.map_concat(envelope, checks(coordinate_format=rid["valid"]))).otherwise(envelope)
    made = (
        F.when(r["format"] == "dsse", checks(dsse_signature=F.col("_sig"), payload_type=r["payload_type"] == F.lit(dsse_type)))
        .when(r["format"] == "envelope_v1", envelope)
        .when(r["format"] == "core", checks(signature=F.col("_sig"), payload_hash_format=hash_there, coordinate_format=coord["format"] == "seal", signer_key=r["signer"] == F.col("_key")))
        .when(r["format"] == "legacy", checks(signature=F.col("_sig"), payload_hash_present=hash_there, canon_version=r["canon_one"], signer_key=r["signer"] == F.col("_key")))
        .otherwise(checks(readable=F.lit(False)))
    )
    d = d.withColumn("checks", made)
    source = F.when(F.nullif("_given", F.lit("")).isNotNull(), "explicit").when(r["own_key"].isNotNull(), "receipt").otherwise("none")
    return d.select(
        F.col(id_col), r["format"].alias("format"), r["label"].alias("receipt_label"), r["type"].alias("receipt_type"), r["signed_at"].alias("signed_at"), source.alias("key_source"),
        F.col("checks"), F.when(r["format"] == "envelope_v1", errors).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.forall(F.map_values("checks"), lambda x: x).alias("valid"), r["claims"].alias("claims"),
    )


def report_json(reported: DataFrame) -> DataFrame:
    return reported.select(F.to_json(F.struct("*")).alias("value"))


def report_text(reported: DataFrame) -> DataFrame:
    """A few lines a receipt, for people."""
    rows = F.transform(F.map_entries("checks"), lambda e: F.concat(F.lit("  "), F.when(e["value"], "[pass] ").otherwise("[FAIL] "), e["key"]))
    return reported.select(F.concat_ws("\n", F.concat_ws(" ", F.lit("Receipt"), "receipt_label", F.concat(F.lit("("), "format", F.lit(")"))), F.array_join(rows, "\n"), F.when(F.col("valid"), "VALID").otherwise("INVALID")).alias("value"))
