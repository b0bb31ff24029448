"""Key history as a table: an append-only log of events, folded to keys with their times, and as-of joins against it.

Events are (issuer, at, event, keyid, ...): `create` makes a key, `rotate` makes one and puts it to use in the place of the issuer's last,
`use` puts a key to use, `revoke` ends it for good. Times are texts in UTC (2024-05-01T00:00:00Z), whose order is that of time.

Which key an issuer signed with at a time is an as-of join: as_of() sorts rows and changes together within spans of time, so an issuer with
most of the rows is dealt out by span, and what an earlier span ended with is carried over in a table of one row a span. Nothing is compared pair by pair.

Edge cases: rows with a null issuer or time, or before the first change, find nothing and stay; of changes at one time the greatest by `tie`
counts, and it counts at that time already; repeated rows stay repeated; a key made twice is the first one; events of other kinds, and of
keys that were never made, change nothing; empty tables give empty or unmatched rows; clashing column names raise ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyseal.functions import crypto, encoding
from tallyseal.operators import keys as K
from tallyseal.operators import receipts

MADE = ("create", "rotate")
DAY = 86_400


def fold(events: DataFrame) -> DataFrame:
    """(issuer, keyid, algorithm, created_utc, expires_utc, revoked_utc, hmac_secret_b64, public_key_pem): a row a key that was made."""
    made = F.when(F.col("event").isin(*MADE), F.struct("at", "algorithm", "expires_utc", "hmac_secret_b64", "public_key_pem"))
    each = events.where("keyid is not null").groupBy("issuer", "keyid").agg(F.min(made).alias("m"), F.min(F.when(F.col("event") == "revoke", F.col("at"))).alias("revoked_utc"))
    return each.where("m is not null").select("issuer", "keyid", "m.algorithm", F.col("m.at").alias("created_utc"), "m.expires_utc", "revoked_utc", "m.hmac_secret_b64", "m.public_key_pem")


def uses(events: DataFrame) -> DataFrame:
    """(issuer, at, keyid): from when on an issuer signs with a key. Events of keys that were never made are none."""
    made = fold(events).select("issuer", "keyid", "created_utc")
    used = events.where(F.col("event").isin("rotate", "use")).join(made, ["issuer", "keyid"])
    return used.where(F.col("at") >= F.col("created_utc")).select("issuer", "at", "keyid")


def as_of(rows: DataFrame, changes: DataFrame, *, by: list[str], at: str, changed: str, take: list[str], tie: str, span: int = 7 * DAY) -> DataFrame:
    """rows with the columns `take` of the last change at or before their time `at` with equal `by`; changes have the time `changed`.

    span: seconds of the spans in which rows and changes meet; a span of one `by` is one task's.
    """
    names = [c.lower() for c in rows.columns]
    if {c.lower() for c in take} & set(names) or any(c.startswith("_asof") for c in names):
        raise ValueError(f"rows must not have columns named like {take}, or _asof...")

    def placed(t: Column) -> Column:
        return F.floor(F.unix_timestamp(t.cast("timestamp")) / span).alias("_asof_span")

    kind = F.struct(F.col(changed).alias("at"), F.col(tie).alias("tie"), F.struct(*take).alias("take"))
    own = changes.where(F.col(changed).isNotNull()).dropna(subset=by).select(*by, F.col(changed).alias("_asof_t"), kind.alias("_asof_c")).withColumn("_asof_span", placed(F.col("_asof_t"))).where("_asof_span is not null")
    given = rows.select(*by, F.col(at).alias("_asof_t"), F.struct("*").alias("_asof_row")).withColumn("_asof_span", placed(F.col("_asof_t")))
    good = F.col("_asof_span").isNotNull()
    for c in by:
        good = good & F.col(c).isNotNull()
    able, unable = given.where(good), given.where(~good)
    # what each span begins with: changes are first reduced to the last of a span, so few rows are sorted by issuer
    last = own.groupBy(*by, "_asof_span").agg(F.max("_asof_c").alias("_asof_last"))
    spans = last.unionByName(able.select(*by, "_asof_span").distinct(), allowMissingColumns=True).groupBy(*by, "_asof_span").agg(F.max("_asof_last").alias("_asof_last"))
    before = Window.partitionBy(*by).orderBy("_asof_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*by, "_asof_span", F.last("_asof_last", ignorenulls=True).over(before).alias("_asof_carry")).where("_asof_carry is not null")
    both = able.withColumn("_asof_is", F.lit(1)).unionByName(own.withColumn("_asof_is", F.lit(0)), allowMissingColumns=True)
    within = Window.partitionBy(*by, "_asof_span").orderBy("_asof_t", "_asof_is", "_asof_c.tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_asof_got", F.last("_asof_c", ignorenulls=True).over(within)).where("_asof_is = 1")
    found = met.join(carried, [*by, "_asof_span"], "left").select("_asof_row.*", F.coalesce("_asof_got", "_asof_carry")["take"].alias("_asof_take"))
    none = F.lit(None).cast(found.schema["_asof_take"].dataType)
    every = found.union(unable.select("_asof_row.*", none.alias("_asof_take")))
    return every.select(*rows.columns, *[F.col("_asof_take")[c].alias(c) for c in take])


def refusal(at: Column) -> Column:
    """Why a key row doesn't count for what was signed at a time: null where it does. The key's own times are columns."""
    ends = F.nullif("expires_utc", F.lit(""))
    return (
        F.when(F.col("created_utc").isNull(), "not found in history")
        .when(at < F.col("created_utc"), "signed before the key was made")
        .when(F.col("revoked_utc").isNotNull() & (at >= F.col("revoked_utc")), F.concat(F.lit("signed after revocation at "), "revoked_utc"))
        .when(ends.isNotNull() & (at >= ends), F.concat(F.lit("signed after expiry at "), ends))
    )


def _with_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a key table: sent to all executors up to BROADCAST_KEYS rows (counted), by shuffle beyond."""
    few = keys.limit(K.BROADCAST_KEYS + 1).count() <= K.BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, on, "left")


def signing_key(rows: DataFrame, events: DataFrame, *, at: str, issuer: str = "issuer", span: int = 7 * DAY) -> DataFrame:
    """rows with (keyid, refused): the key that the issuer used at the row's time, and why it must not sign then, if so."""
    rows = rows.withColumnRenamed(issuer, "issuer")
    found = as_of(rows, uses(events).withColumnRenamed("at", "_changed"), by=["issuer"], at=at, changed="_changed", take=["keyid"], tie="keyid", span=span)
    times = fold(events).select("issuer", "keyid", "created_utc", "expires_utc", "revoked_utc")
    out = _with_keys(found, times, ["issuer", "keyid"])
    return out.select(F.col("issuer").alias(issuer), *[c for c in rows.columns if c != "issuer"], "keyid", F.when(F.col("keyid").isNull(), "no key in use").otherwise(refusal(F.col(at))).alias("refused"))


def sign_each(df: DataFrame, keys: DataFrame, *, at: str, payload_type: str = receipts.PAYLOAD_TYPE, receipt_id: Column | None = None, policy_version: str = "1.0.0", algorithm: str = "SHA-256") -> DataFrame:
    """df(issuer, keyid, frozen_hash, canonical_form, ...) with an envelope by each row's own HMAC key, at the time `at` of the row; null where the key table has none."""
    pads = F.when(F.col("algorithm") == K.HMAC, encoding.hmac_pads(F.unbase64("hmac_secret_b64")))
    held = _with_keys(df, keys.select("issuer", "keyid", pads.alias("_pads")), ["issuer", "keyid"])
    parts = {
        "receipt_id": receipt_id if receipt_id is not None else F.expr("uuid()"), "timestamp_utc": F.col(at), "frozen_hash": F.col("frozen_hash"),
        "canonical_form_hash": F.sha2("canonical_form", 256), "policy_version": F.lit(policy_version), "hash_algorithm": F.lit(algorithm),
    }
    made = held.select("*", F.inline(F.array(F.struct(F.encode(receipts.payload_json(**parts), "UTF-8").alias("_payload")))))
    sig = encoding.b64url(F.unhex(encoding.hmac_sha256(F.col("_pads"), encoding.pae(F.lit(payload_type), F.col("_payload")))))
    envelope = F.struct(F.lit(payload_type).alias("payloadType"), encoding.b64url(F.col("_payload")).alias("payload"), F.array(F.struct(F.col("keyid").alias("keyid"), sig.alias("sig"))).alias("signatures"))
    return made.withColumn("envelope", F.when(F.col("_pads").isNotNull(), envelope)).select(*df.columns, "envelope")


def verify_at(df: DataFrame, keys: DataFrame, *, id_col: str = "id", issuer: str = "issuer", payload_type: str = receipts.PAYLOAD_TYPE) -> DataFrame:
    """(id, valid, keyid, reason) of envelopes by the keys as they were when each was signed (payload's time): a revoked key still speaks for what it signed before. The first good signature counts; otherwise all reasons are told, in the order of signatures."""
    e = F.col("envelope")
    none = F.array().cast("array<struct<keyid:string,sig:string>>")
    rows = df.select(F.col(id_col).alias("_id"), F.col(issuer).alias("issuer"), F.inline(F.array(F.struct(e["payloadType"].alias("_type"), encoding.from_b64(e["payload"]).alias("_data"), F.coalesce(e["signatures"], none).alias("_s")))))
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_p", receipts._fields_of(F.col("_data")))
    early = (
        F.when(F.col("_data").isNull(), "Undecodable payload").when(~F.col("_type").eqNullSafe(F.lit(payload_type)), "Unexpected payloadType")
        .when(F.size("_s") == 0, "No signatures in envelope").when(F.col("_p").isNull(), "Malformed payload")
    )
    rows = rows.withColumn("_early", early)
    each = rows.select("_n", "_id", "issuer", "_early", F.col("_p.timestamp_utc").alias("_at"), F.when(F.col("_early").isNull(), encoding.pae(F.lit(payload_type), F.col("_data"))).alias("_message"), F.posexplode_outer(F.when(F.col("_early").isNull(), F.col("_s"))).alias("_k", "_sig"))
    pads = F.when(F.col("algorithm") == K.HMAC, encoding.hmac_pads(F.unbase64("hmac_secret_b64")))
    known = keys.select("issuer", "keyid", "algorithm", "created_utc", "expires_utc", "revoked_utc", "public_key_pem", pads.alias("_pads"))
    held = _with_keys(each.withColumn("keyid", F.col("_sig.keyid")), known, ["issuer", "keyid"])
    sig = encoding.from_b64(F.col("_sig.sig"))
    by_curve = F.col("algorithm") == K.ECDSA
    right = F.when(F.col("algorithm") == K.HMAC, F.unhex(encoding.hmac_sha256(F.col("_pads"), F.col("_message"))) == sig).when(by_curve, crypto.p256_valid(F.when(by_curve, F.col("public_key_pem")), F.when(by_curve, F.col("_message")), F.when(by_curve, sig)))
    why = F.when(F.col("created_utc").isNull(), "not found in history").when(~F.coalesce(right, F.lit(False)), F.when(F.col("algorithm").isin(K.HMAC, K.ECDSA), "signature mismatch").otherwise(F.concat(F.lit("unknown algorithm "), "algorithm"))).otherwise(refusal(F.col("_at")))
    judged = held.withColumn("_why", F.when(F.col("_k").isNotNull(), why))
    good = F.when(F.col("_k").isNotNull() & F.col("_why").isNull(), F.struct("_k", "keyid"))
    told = F.when(F.col("_why").isNotNull(), F.struct("_k", F.concat_ws(": ", F.coalesce("keyid", F.lit("")), "_why").alias("why")))
    out = judged.groupBy("_n").agg(F.first("_id").alias(id_col), F.first("_early").alias("_early"), F.min(good).alias("_good"), F.array_sort(F.collect_list(told)).alias("_told"))
    valid = F.col("_good").isNotNull()
    return out.select(id_col, valid.alias("valid"), F.col("_good.keyid").alias("keyid"), F.when(valid, "Signature valid").otherwise(F.coalesce("_early", F.array_join(F.transform("_told", lambda x: x["why"]), "; "))).alias("reason"))
