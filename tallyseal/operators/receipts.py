"""Receipts: payload, envelope, signing and verification of whole tables."""

from __future__ import annotations

import hmac
import json
import zlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.functions import crypto, encoding, strings
from tallyseal.operators import keys as K

PAYLOAD_TYPE = "application/vnd.tallyseal.receipt+json"
FIELDS = ("canonical_form_hash", "frozen_hash", "hash_algorithm", "policy_version", "receipt_id", "timestamp_utc")  # sorted
ENVELOPE = "struct<payloadType:string,payload:string,signatures:array<struct<keyid:string,sig:string>>>"


def payload_json(**columns: Column | str) -> Column:
    """Sorted compact JSON of the six payload strings; those that are the same in all rows may come as str."""

    def text(c: Column | str) -> Column:
        return F.lit(json.dumps(c)) if isinstance(c, str) else strings.json_text(c, native=True)

    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), text(columns[k])) for k in FIELDS]), F.lit("}"))


def signer(keys: DataFrame, keyid: str | None = None, at: str | None = None) -> tuple[str, str]:
    """(keyid, algorithm) of the key to sign with, the table's current one if none is named. Raises ValueError where it is missing, not valid at a time (now if none), or of an unknown algorithm."""
    public = keys.select("keyid", "algorithm", "created_utc", "expires_utc", "revoked_utc", "active", "current")
    rows = public.where(F.col("keyid") == keyid if keyid else F.col("current")).limit(2).collect()
    if not rows:
        raise ValueError(f"key {keyid} is not in the key table" if keyid else "no key is named and the key table has no current one")
    if len(rows) > 1:
        raise ValueError(f"more than one key row for {rows[0]['keyid']}")
    r = rows[0]
    key = K.Key(r["keyid"], r["algorithm"], r["created_utc"], r["expires_utc"], r["revoked_utc"], r["active"] is not False)
    if not key.valid_at(at):
        raise ValueError(f"key {key.keyid} is not valid")
    if key.algorithm not in (K.HMAC, K.ECDSA):
        raise ValueError(f"key {key.keyid} has the unknown algorithm {key.algorithm}")
    return key.keyid, key.algorithm


def sign(df: DataFrame, keys: DataFrame, keyid: str | None = None, *, payload_type: str = PAYLOAD_TYPE, policy_version: str = "1.0.0", algorithm: str = "SHA-256", receipt_id: Column | None = None, when: Column | str | None = None, at: str | None = None) -> DataFrame:
    """df(frozen_hash, canonical_form, ...) with a signed envelope, HMAC in the JVM, ECDSA in Arrow batches.

    keyid: the table's current key if none; it must be valid `at` a time (now if none), else ValueError. Ids (receipt_id) and
    times (when) are inputs where results must be the same again. The secret reaches executors as a joined row, not as a literal.
    """
    keyid, kind = signer(keys, keyid, at)
    material = encoding.hmac_pads(F.unbase64("hmac_secret_b64")) if kind == K.HMAC else F.col("private_key_pem")
    chosen = keys.where(F.col("keyid") == keyid).select(F.col("keyid").alias("_keyid"), material.alias("_key"))
    parts = {
        "receipt_id": receipt_id if receipt_id is not None else F.expr("uuid()"),
        "timestamp_utc": when if when is not None else K.now_text(),
        "frozen_hash": F.col("frozen_hash"),
        "canonical_form_hash": F.sha2("canonical_form", 256),
        "policy_version": policy_version,
        "hash_algorithm": algorithm,
    }
    # a generated row is made once, whatever mentions it
    made = df.select("*", F.lit(keyid).alias("_keyid"), *_fixed(_payload=F.encode(payload_json(**parts), "UTF-8")))
    made = made.join(F.broadcast(chosen), "_keyid")  # one row, as signer() has checked
    message = encoding.pae(F.lit(payload_type), F.col("_payload"))
    sig = F.unhex(encoding.hmac_sha256(F.col("_key"), message)) if kind == K.HMAC else crypto.p256_signature(F.col("_key"), message)
    envelope = F.struct(F.lit(payload_type).alias("payloadType"), encoding.b64url(F.col("_payload")).alias("payload"), F.array(F.struct(F.col("_keyid").alias("keyid"), encoding.b64url(sig).alias("sig"))).alias("signatures"))
    return made.withColumn("envelope", envelope).drop("_keyid", "_key", "_payload")


def envelope_json(c: Column) -> Column:
    return F.to_json(c)


def parse_envelope(text: Column) -> Column:
    def read(parsed: Column) -> Column:
        return F.struct(parsed["payloadType"].alias("payloadType"), parsed["payload"].alias("payload"), F.coalesce(parsed["signatures"], F.array().cast("array<struct<keyid:string,sig:string>>")).alias("signatures"))

    return strings.once(F.from_json(text, ENVELOPE), read)  # each field asked of from_json itself would be a parse of its own


def _fixed(**columns: Column) -> list[Column]:
    """The columns as a generated row: each is made once, whatever mentions it later."""
    return [F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))]


def _fields_of(data: Column) -> Column:
    def read(text: Column) -> Column:
        parsed = F.from_json(text, "struct<" + ",".join(f"{k}:string" for k in FIELDS) + ">")
        return F.when(F.sort_array(F.json_object_keys(text)) == F.array(*map(F.lit, FIELDS)), parsed)

    return strings.once(F.try_validate_utf8(data.cast("string")), read)


def payload_of(envelope: Column) -> Column:
    """The six strings, or null where a key is missing, strange or no string."""
    return _fields_of(encoding.from_b64(envelope["payload"]))


def _refusal(key: dict | None, message: bytes, sig: bytes | None, signed: str, enforce: bool) -> str | None:
    """Why a signature doesn't count: key known, not revoked, algorithm known, signature right, signed before expiry."""
    if key is None:
        return "not found in registry"
    if key["revoked_utc"] is not None:
        return f"key revoked at {key['revoked_utc']}"
    if key["algorithm"] not in (K.HMAC, K.ECDSA):
        return f"unknown algorithm '{key['algorithm']}'"
    if key["algorithm"] == K.HMAC:
        right = bool(key["secret"]) and sig is not None and hmac.compare_digest(hmac.digest(key["secret"], message, "sha256"), sig)
    else:
        right = bool(key["pem"]) and sig is not None and crypto.p256_verify(key["pem"], message, sig)
    if not right:
        return "signature mismatch"
    if enforce and key["expires_utc"] and signed >= key["expires_utc"]:
        return f"signed after key expiry (key expired {key['expires_utc']}, receipt signed {signed})"
    return None


def _lists(a: pa.Array) -> list[list]:
    """Items of a list array by row; a null row has none."""
    flat, ends = a.flatten().to_pylist(), pc.cumulative_sum(pc.fill_null(a.value_lengths(), 0)).to_pylist()
    return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _judged(look_up, enforce: bool):
    """An Arrow UDF of (message, time, key ids, signatures and, unless look_up gives the key of an id, keys). The first good signature decides; otherwise all reasons are told. Rows without a message are left out."""
    fields = {"valid": pa.bool_(), "keyid": pa.string(), "algorithm": pa.string(), "created": pa.string(), "expires": pa.string(), "errors": pa.list_(pa.string())}

    @F.arrow_udf(T.StructType.fromDDL("valid boolean, keyid string, algorithm string, created string, expires string, errors array<string>"))
    def run(message: pa.Array, signed: pa.Array, names: pa.Array, sigs: pa.Array, *keys: pa.Array) -> pa.Array:
        if message.null_count == len(message):
            return pa.nulls(len(message), pa.struct(list(fields.items())))
        ids = _lists(names)
        found = _lists(keys[0]) if keys else [[look_up(x) for x in row] for row in ids]
        out = []
        for data, time, own, marks, held in zip(message.to_pylist(), signed.to_pylist(), ids, _lists(sigs), found, strict=True):
            errors, good = [], None
            for name, sig, key in zip(own, marks, held, strict=True) if data is not None else ():
                why = _refusal(key, data, sig, time, enforce)
                if why is None:
                    good = (True, name, key["algorithm"], key["created_utc"], key["expires_utc"], None)
                    break
                errors.append(f"{name or ''}: {why}")
            out.append(good or (False, None, None, None, None, errors))
        cols = list(zip(*out, strict=True)) or [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, fields.values(), strict=True)], list(fields))

    return run


def _key_of(spark: SparkSession, known: dict[str, dict], keyid: Column) -> Column:
    """The key of an id, null if unknown, from a table of buckets. It holds secrets, so it is a row that a subquery reads, not a literal."""
    buckets: list[dict] = [{} for _ in range(len(known) or 1)]
    for name, k in known.items():
        pads = encoding.py_hmac_pads(k["secret"]) if k["secret"] else None
        buckets[zlib.crc32(name.encode()) % len(buckets)][name] = (k["algorithm"], k["created_utc"], k["expires_utc"], k["revoked_utc"], pads)
    held = spark.createDataFrame([(buckets,)], "b array<map<string,struct<algorithm:string,created_utc:string,expires_utc:string,revoked_utc:string,pads:struct<inner:binary,outer:binary>>>>")
    return F.try_element_at(F.get(held.scalar(), (F.crc32(F.encode(keyid, "UTF-8")) % len(buckets)).cast("int")), keyid)


def _judged_natively(alone: Column, message: Column, signed: Column, enforce: bool) -> list[Column]:
    """_refusal() without Python for rows of one signature whose key (_key, null if unknown) is no ECDSA key: what _judged() gives, as _one."""
    k, s = F.col("_key"), F.get("_s", F.lit(0))
    right = F.unhex(encoding.hmac_sha256(k["pads"], message)) == encoding.from_b64(s["sig"])
    why = (
        F.when(k.isNull(), "not found in registry").when(k["revoked_utc"].isNotNull(), F.concat(F.lit("key revoked at "), k["revoked_utc"]))
        .when(~k["algorithm"].eqNullSafe(F.lit(K.HMAC)), F.concat(F.lit("unknown algorithm '"), F.coalesce(k["algorithm"], F.lit("None")), F.lit("'")))
        .when(~F.coalesce(right, F.lit(False)), "signature mismatch")
    )
    if enforce:
        why = why.when((k["expires_utc"] != "") & (signed >= k["expires_utc"]), F.concat(F.lit("signed after key expiry (key expired "), k["expires_utc"], F.lit(", receipt signed "), signed, F.lit(")")))
    good = {"keyid": s["keyid"], "algorithm": k["algorithm"], "created": k["created_utc"], "expires": k["expires_utc"]}

    def told(x: Column) -> Column:
        errors = F.when(x.isNotNull(), F.array(F.concat(F.coalesce(s["keyid"], F.lit("")), F.lit(": "), x)))
        return F.struct(x.isNull().alias("valid"), *[F.when(x.isNull(), c).alias(n) for n, c in good.items()], errors.alias("errors"))

    return _fixed(_one=F.when(alone, strings.once(why, told)))


def verify(df: DataFrame, keys: DataFrame, *, id_col: str = "id", payload_type: str = PAYLOAD_TYPE, enforce_sign_time: bool = True, most_keys: int = K.BROADCAST_KEYS) -> DataFrame:
    """One row an envelope: valid, keyid, reason, signed_while_valid, key_algorithm, key_created, key_expires, errors.

    Checks in order: decodable payload, type, signatures there, six payload fields; then signatures in array order: key known, not revoked,
    algorithm known, signature right, signed before expiry. The first good signature decides; otherwise all reasons are joined.

    Every row is judged by itself, whatever ids repeat or are null. Up to `most_keys` keys are sent to all executors (counted before),
    and rows with one signature, by no ECDSA key, are judged in the JVM, all others in Python; beyond, each row's keys are fetched by a
    shuffle join, salted as one key may have signed most receipts.
    """
    e = F.col("envelope")
    signatures = F.coalesce(e["signatures"], F.array().cast("array<struct<keyid:string,sig:string>>"))
    rows = df.select(F.col(id_col).alias("_id"), *_fixed(_type=e["payloadType"], _payload=e["payload"], _s=signatures))
    rows = rows.select("_id", "_type", "_s", *_fixed(_data=encoding.from_b64(F.col("_payload"))))
    rows = rows.select("*", *_fixed(_p=_fields_of(F.col("_data"))))
    early = (
        F.when(F.col("_data").isNull(), "Undecodable payload")
        .when(~F.col("_type").eqNullSafe(F.lit(payload_type)), F.concat(F.lit("Unexpected payloadType: "), F.coalesce("_type", F.lit(""))))
        .when(F.size("_s") <= 0, "No signatures in envelope")
        .when(F.col("_p").isNull(), "Malformed payload")
    )
    rows = rows.withColumn("_early", early).withColumn("_names", F.transform("_s", lambda x: x["keyid"]))
    table = K.signing_material(keys)
    message, signed, alone = encoding.pae(F.lit(payload_type), F.col("_data")), F.col("_p.timestamp_utc"), F.lit(False)
    if table.limit(most_keys + 1).count() <= most_keys:
        known = {r["keyid"]: r.asDict() | {"secret": r["secret"] and bytes(r["secret"])} for r in table.collect()}
        held = df.sparkSession.sparkContext.broadcast(known)
        judged, found = _judged(lambda name: held.value.get(name), enforce_sign_time), []
        rows = rows.select("*", *_fixed(_key=_key_of(df.sparkSession, known, F.get("_names", F.lit(0)))))
        alone = F.col("_early").isNull() & (F.size("_s") == 1) & ~F.col("_key.algorithm").eqNullSafe(F.lit(K.ECDSA)) & signed.isNotNull()
        rows = rows.select("*", *_judged_natively(alone, message, signed, enforce_sign_time))
    else:
        salts = 64
        numbered = rows.withColumn("_n", F.monotonically_increasing_id())
        each = numbered.select("*", F.posexplode_outer("_names").alias("_at", "keyid")).withColumn("_salt", F.pmod("_n", F.lit(salts)))
        copies = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
        pairs = each.join(copies.withColumn("_key", F.struct(*table.columns)).select("keyid", "_salt", "_key"), ["keyid", "_salt"], "left")
        kept = [F.first(c).alias(c) for c in numbered.columns if c != "_n"]
        rows = pairs.groupBy("_n").agg(*kept, F.transform(F.array_sort(F.collect_list(F.struct("_at", "_key"))), lambda x: x["_key"]).alias("_keys"))
        judged, found = _judged(None, enforce_sign_time), [F.col("_keys")]
    sigs, open_ = F.transform("_s", lambda x: encoding.from_b64(x["sig"])), F.col("_early").isNull() & ~alone
    # empty lists, as Arrow's writer goes over all null lists of a batch again at each row
    lists = [F.when(open_, c).otherwise(F.array().cast("array<" + t + ">")) for c, t in ((F.col("_names"), "string"), (sigs, "binary"))]
    by_python = judged(F.when(open_, message), F.when(open_, signed), *lists, *found)
    out = rows.select("_id", "_early", (F.coalesce("_one", by_python) if "_one" in rows.columns else by_python).alias("_v"))
    valid, errors = F.coalesce("_v.valid", F.lit(False)), F.coalesce(F.when(F.col("_early").isNotNull(), F.array("_early")), F.col("_v.errors"))
    return out.select(
        F.col("_id").alias(id_col), valid.alias("valid"), F.col("_v.keyid").alias("keyid"), F.when(valid, F.lit("Signature valid")).otherwise(F.array_join(errors, "; ")).alias("reason"),
        F.col("_v.algorithm").alias("key_algorithm"), F.col("_v.created").alias("key_created"), F.col("_v.expires").alias("key_expires"), valid.alias("signed_while_valid"), F.when(~valid, errors).alias("errors"),
    )


def save(df: DataFrame, path: str) -> dict:
    """Envelopes as JSON lines and, after them, a manifest (receipt_id, frozen_hash) as JSON lines, both from one written table (path/store), so that ids agree; returns its numbers."""
    from tallyseal.operators.receipt_store import ReceiptStore

    store = ReceiptStore(df.sparkSession, f"{path}/store")
    numbers = store.append(df, "all")
    store.receipts("all").write.text(f"{path}/receipts")
    store.manifest("all").select("receipt_id", "frozen_hash").write.json(f"{path}/manifest")
    return numbers


def chain_breaks(df: DataFrame, by: str, order: str, own: str, prior: str) -> DataFrame:
    """Rows whose prior link is not the hash of the row before."""
    return df.withColumn("_last", F.lag(own).over(Window.partitionBy(by).orderBy(order))).where(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col(prior))).drop("_last")
