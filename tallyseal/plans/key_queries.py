"""Registered queries over keys, their history, signatures, vectors and the hash index, all made from the given tables, with their DuckDB statements."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.functions import crypto, schemaless, strings
from tallyseal.operators import hashing, key_history, policy_change, prove, receipts, verify
from tallyseal.operators import keys as K
from tallyseal.operators.index import HashIndex
from tallyseal.plans import catalog, receipt_queries
from tallyseal.plans.policy import from_toml
from tallyseal.sources import files
from tallyseal.sources.shared import scratch_path

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
SQL_ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _text(c) -> Column:
    return F.date_format(c, ISO)


def _pick(k: Column, *values) -> Column:
    """The value at a number from 0."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k + 1).cast("int"))


# -- keys ---------------------------------------------------------------------------------------------------------------------------


def _supplier_keys(spark, d) -> DataFrame:
    """A key a supplier: algorithms, times, revocations and rest by its number."""
    s = catalog._t(spark, d, "supplier", "s_suppkey", "s_name")
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    algorithm = F.when(k % 6 == 0, "RSA").otherwise(K.HMAC)
    return s.select(
        "s_suppkey", F.concat(F.lit("key"), k.cast("string")).alias("keyid"), algorithm.alias("algorithm"), F.lit("2024-01-01T00:00:00Z").alias("created_utc"),
        _pick(k % 4, none, "", "2024-03-01T00:00:00Z", "2099-01-01T00:00:00Z").alias("expires_utc"), F.when(k % 5 == 0, "2024-02-01T00:00:00Z").alias("revoked_utc"), F.when(k % 7 != 0, k % 3 != 0).alias("active"),
        F.when(algorithm == K.HMAC, F.base64(F.encode("s_name", "UTF-8"))).alias("hmac_secret_b64"), none.alias("hmac_fingerprint"), none.alias("private_key_pem"), none.alias("public_key_pem"), F.lit(False).alias("current"),
    )


def key_validity(spark, d):
    return _supplier_keys(spark, d).select("keyid", K.is_valid(F.lit(catalog.WHEN)).alias("valid"))


def public_export(spark, d):
    return K.public_keys(_supplier_keys(spark, d)).select("keyid", "algorithm", "hmac_fingerprint", "active")


_VALIDITY_SQL = """
select 'key' || s_suppkey as keyid, s_suppkey % 5 <> 0 and (s_suppkey % 7 = 0 or s_suppkey % 3 <> 0) and s_suppkey % 4 <> 2 as valid from supplier
"""
_EXPORT_SQL = f"""
select 'key' || s_suppkey as keyid, case when s_suppkey % 6 = 0 then 'RSA' else '{K.HMAC}' end as algorithm, case when s_suppkey % 6 <> 0 then substr(sha256(s_name), 1, 16) end as hmac_fingerprint,
       case when s_suppkey % 7 <> 0 then s_suppkey % 3 <> 0 end as active
from supplier
"""


def _event(at: Column, event: str, keyid: Column, expires: Column | None = None) -> Column:
    made = event in key_history.MADE
    none = F.lit(None).cast("string")
    return F.struct(
        _text(at).alias("at"), F.lit(event).alias("event"), keyid.alias("keyid"), (F.lit(K.HMAC) if made else none).alias("algorithm"), (none if expires is None else _text(expires)).alias("expires_utc"),
        (F.base64(F.encode(F.concat(F.lit("secret of "), keyid), "UTF-8")) if made else none).alias("hmac_secret_b64"), none.alias("public_key_pem"),
    )


def key_lifecycle(spark, d):
    """A key log for each nation: one made, rotated away, one kept beside, one revoked; which are valid and in use at a day."""
    n = catalog._t(spark, d, "nation", "n_nationkey", "n_name")

    def day(k: int) -> Column:
        return F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(n_nationkey + {k} as int))")

    one, two, extra, gone = (F.concat(F.lit(f"{x} "), "n_name") for x in ("one", "two", "extra", "gone"))
    log = F.array(_event(day(0), "rotate", one, day(90)), _event(day(30), "rotate", two, day(60)), _event(day(31), "create", extra, day(31)), _event(day(32), "create", gone), _event(day(40), "revoke", gone), _event(day(50), "use", one))
    events = n.select(F.col("n_name").alias("issuer"), F.inline(log))
    keys, at = key_history.fold(events), _text(F.expr("timestamp_ntz'2024-03-01 00:00:00'"))
    asked = n.select(F.col("n_name").alias("issuer"), at.alias("at"))
    used = key_history.signing_key(asked, events, at="at").select("issuer", F.col("keyid").alias("used"))
    return keys.join(used, "issuer").select("issuer", "keyid", "created_utc", key_history.refusal(at).isNull().alias("valid"), F.col("keyid").eqNullSafe(F.col("used")).alias("in_use"))


_LIFECYCLE_SQL = f"""
with k as (select n_nationkey as n, n_name, timestamp '2024-01-01' + interval (n_nationkey) day as t, timestamp '2024-03-01' as w from nation),
e as (
  select n_name as issuer, 'one ' || n_name as keyid, t as made, t + interval 90 day as ends, null::timestamp as gone, w, t from k
  union all select n_name, 'two ' || n_name, t + interval 30 day, t + interval 60 day, null, w, t from k
  union all select n_name, 'extra ' || n_name, t + interval 31 day, t + interval 31 day, null, w, t from k
  union all select n_name, 'gone ' || n_name, t + interval 32 day, null, t + interval 40 day, w, t from k
)
select issuer, keyid, strftime(made, {SQL_ISO}) as created_utc, made <= w and (ends is null or w < ends) and (gone is null or w < gone) as valid,
       case when t + interval 50 day <= w then keyid like 'one %' when t + interval 30 day <= w then keyid like 'two %' when t <= w then keyid like 'one %' else false end as in_use
from e
"""


def _order_log(spark, d) -> DataFrame:
    """Keys of customers: an urgent order is a rotation, and every third of these keys is revoked some days later."""
    o = catalog._t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").where(F.col("o_orderpriority") == "1-URGENT")
    keyid = F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))
    made = _event(F.col("o_orderdate"), "rotate", keyid, F.expr("o_orderdate + interval 90 days"))
    gone = _event(F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 60 as int))"), "revoke", keyid)
    return o.select(F.col("o_custkey").alias("issuer"), F.inline(F.when(F.col("o_orderkey") % 3 == 0, F.array(made, gone)).otherwise(F.array(made))))


def _orders_with_keys(spark, d) -> tuple[DataFrame, DataFrame]:
    events = _order_log(spark, d)
    o = catalog._t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", F.col("o_custkey").alias("issuer"), _text("o_orderdate").alias("signed_at"))
    return key_history.signing_key(o, events, at="signed_at"), events


def key_as_of(spark, d):
    """The key that each order's customer used at its date, and why it must not sign, if so."""
    return _orders_with_keys(spark, d)[0].select("o_orderkey", "keyid", "refused")


_AS_OF = f"""
with e as (select o_custkey, o_orderdate as since, max('k' || o_orderkey) as keyid from orders where o_orderpriority = '1-URGENT' group by all),
k as (select 'k' || o_orderkey as keyid, o_orderdate + interval 90 day as ends, case when o_orderkey % 3 = 0 then o_orderdate + interval (o_orderkey % 60) day end as gone from orders where o_orderpriority = '1-URGENT'),
a as (
  select o.o_orderkey, e.keyid, case when e.keyid is null then 'no key in use' when o.o_orderdate >= gone then 'signed after revocation at ' || strftime(gone, {SQL_ISO}) when o.o_orderdate >= ends then 'signed after expiry at ' || strftime(ends, {SQL_ISO}) end as refused
  from orders o asof left join e on o.o_custkey = e.o_custkey and o.o_orderdate >= e.since left join k on k.keyid = e.keyid
)
"""


def history_receipts(spark, d):
    """Orders signed by their customer's key of the day, right or not, every fifth with another signature, judged by the keys' history."""
    o, events = _orders_with_keys(spark, d)
    keys = key_history.fold(events)
    text = F.col("o_orderkey").cast("string")
    o = o.withColumn("canonical_form", text).withColumn("frozen_hash", F.sha2(text, 256))
    signed = key_history.sign_each(o, keys, at="signed_at", receipt_id=F.concat(F.lit("id"), text))
    e = F.col("envelope")
    bent = F.struct(e["payloadType"].alias("payloadType"), e["payload"].alias("payload"), F.array(F.struct(e["signatures"][0]["keyid"].alias("keyid"), F.lit("AAAA").alias("sig"))).alias("signatures"))
    signed = signed.withColumn("envelope", F.when((F.col("o_orderkey") % 5 == 0) & e.isNotNull(), bent).otherwise(e))
    return key_history.verify_at(signed, keys, id_col="o_orderkey").select("o_orderkey", "valid", "keyid", "reason")


_HISTORY_SQL = (
    _AS_OF
    + """
select o_orderkey, keyid is not null and o_orderkey % 5 <> 0 and refused is null as valid, case when o_orderkey % 5 <> 0 and refused is null then keyid end as keyid,
       case when keyid is null then 'Undecodable payload' when o_orderkey % 5 = 0 then keyid || ': signature mismatch' else coalesce(keyid || ': ' || refused, 'Signature valid') end as reason
from a
"""
)


# -- signatures -------------------------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("sig", T.BinaryType())]))
def _ed25519_signed(who: pd.Series, message: pd.Series) -> pd.DataFrame:
    """By test keys, a seed a number."""
    seeds = [hashlib.sha256(f"test seed {k}".encode()).digest() for k in who]
    return pd.DataFrame({"key": [crypto.ed25519_public(s) for s in seeds], "sig": [crypto.ed25519_sign(s, m.encode()) for s, m in zip(seeds, message, strict=True)]})


def ed25519_verify(spark, d):
    """Suppliers' names signed by 25 keys, a third with another message, a third under a key that isn't theirs."""
    s = catalog._spread(catalog._t(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey"))
    own = s.select("*", _ed25519_signed("s_nationkey", "s_name").alias("own"))
    other = own.select("*", _ed25519_signed(F.col("s_nationkey") + 1, F.lit("")).alias("other"))
    k = F.col("s_suppkey") % 3
    message, key = F.when(k == 1, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")), F.when(k == 2, F.col("other.key")).otherwise(F.col("own.key"))
    return other.select("s_suppkey", crypto.ed25519_valid(key, F.encode(message, "UTF-8"), F.col("own.sig")).alias("valid"))


# -- receipts -----------------------------------------------------------------------------------------------------------------------------


def wrapped_receipts(spark, d):
    """Signed receipts of the four formats, plain, inside a response, inside a response with a demonstration mark, and nested as an envelope."""
    r = catalog._spread(catalog._t(spark, d, "supplier", "s_suppkey", "s_name")).select("s_suppkey", receipt_queries._receipts("s_suppkey", "s_name").alias("receipt"))
    k = F.floor(F.col("s_suppkey") / 12) % 4
    dsse = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit('{"dsse_envelope":'), "receipt", F.lit(',"note":1}'))).otherwise(F.col("receipt"))
    text = F.when(k == 0, F.col("receipt")).when(k == 1, F.concat(F.lit('{"receipt":'), "receipt", F.lit(',"demo":true}'))).when(k == 2, F.concat(F.lit('{"status":"ok","receipt":'), dsse, F.lit("}"))).otherwise(dsse)
    key = F.lit(crypto.ed25519_public(receipt_queries.SEED).hex())
    return verify.report(r.select("s_suppkey", text.alias("receipt"), key.alias("key")), id_col="s_suppkey", key_col="key").select("s_suppkey", "format", "receipt_label", "valid")


_WRAPPED_SQL = """
select s_suppkey, case s_suppkey % 4 when 0 then 'dsse' when 1 then 'envelope_v1' when 2 then 'core' else 'legacy' end as format,
       case s_suppkey % 4 when 0 then 'k' when 1 then 'sha256:' || sha256(s_name) when 2 then 'seal:' || substr(sha256(s_name), 1, 32) else 'unknown' end as receipt_label, s_suppkey // 4 % 3 = 0 as valid
from supplier
"""


def receipt_text(spark, d):
    """Orders' envelopes written as JSON text and read again, every seventh text cut short: payload fields and verdict."""
    s = catalog._signed(spark, d)
    text = strings.once(receipts.envelope_json(F.col("envelope")), lambda x: F.when(F.col("o_orderkey") % 7 == 0, F.substr(x, F.lit(1), F.length(x) - 9)).otherwise(x))
    back = s.select("o_orderkey", receipts.parse_envelope(text).alias("envelope"))
    judged = receipts.verify(back, catalog._keys(spark), id_col="o_orderkey").select("o_orderkey", "valid", "reason")
    return judged


_TEXT_SQL = "select o_orderkey, o_orderkey % 7 <> 0 as valid, case when o_orderkey % 7 = 0 then 'Undecodable payload' else 'Signature valid' end as reason from orders"

POLICY = """
policy_version = "7.1"
[hash]
algorithm = "SHA-256"
output_encoding = "base64"
[string_normalization]
lowercase_strings = true
[json_normalization]
remove_null_fields = false
[synonyms]
enabled = true
[synonyms.mappings]
"BLDG" = "building"
"""


def toml_hash(spark, d):
    """Customers under a policy from TOML: another encoding, lower case, synonyms, nulls kept."""
    c = catalog._t(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    c = c.withColumn("segment", F.when(F.col("c_mktsegment") == "BUILDING", "the Bldg").when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")))
    return c.select("c_custkey", hashing.digest(hashing.row_form(c, ["c_name", "segment"], policy=(p := from_toml(POLICY))), p).alias("h"))


# -- vectors --------------------------------------------------------------------------------------------------------------------------------


def _vectors(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Sameness vectors of each row: what a policy must take for equal and what not. `off` is by how much a number differs; every second row expects it to be equal, right or wrong."""
    k, quoted, off = F.col(key).cast("string"), F.to_json(F.struct(F.col(name).alias("n"))), F.col(key) % 3

    def obj(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    yes, no = F.lit(True), F.lit(False)
    made = [
        ("white space", quoted, F.regexp_replace(quoted, ":", " :\t"), yes, None), ("outer space", quoted, F.replace(quoted, F.lit(':"'), F.lit(':"  ')), yes, None), ("key order", obj('{"x":', k, ',"y":{"b":1,"a":"', k, '"}}'), obj('{"y":{"a":"', k, '","b":1},"x":', k, "}"), yes, None),
        ("number text", obj('{"v":', k, "}"), obj('{"v":', k, ".0}"), yes, None), ("number", obj('{"v":', k, "}"), obj('{"v":', (F.col(key) + off).cast("string"), "}"), F.col(key) % 2 == 0, None),
        ("null is missing", obj('{"a":', k, "}"), obj('{"a":', k, ',"b":null}'), yes, None), ("nonce", obj('{"a":1,"trace_id":"', k, '"}'), obj('{"trace_id":"other","a":1}'), yes, None),
        ("set", obj('{"t":["', k, '","b"]}'), obj('{"t":["b","', k, '"]}'), yes, "t"), ("sequence", obj('{"t":["', k, '","b"]}'), obj('{"t":["b","', k, '"]}'), no, None),
    ]
    each = [F.struct(F.concat(k, F.lit(f" {what}")).alias("id"), F.lit(what).alias("description"), a.alias("a_json"), b.alias("b_json"), same.alias("expect_same"), F.array(*([F.lit(s)] if s else [])).cast("array<string>").alias("set_fields")) for what, a, b, same, s in made]
    return rows.select(F.inline(F.array(*each)))


_KINDS = "(values ('white space', true), ('outer space', true), ('key order', true), ('number text', true), ('number', null), ('null is missing', true), ('nonce', true), ('set', true), ('sequence', false)) v(description, same)"


def conformance_report(spark, d):
    """Vectors of customers by kind: how many hold."""
    found = prove.run(_vectors(catalog._spread(catalog._t(spark, d, "customer", "c_custkey", "c_name")), "c_custkey", "c_name"))
    return found.groupBy("description").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


_CONFORMANCE_SQL = f"""
select description, count(*) as total, count(*) filter (where good) as passed, count(*) filter (where not good) as failed
from (select description, case when same is null then (c_custkey % 2 = 0) = (c_custkey % 3 = 0) else true end as good from customer cross join {_KINDS}) group by description
"""


def proof_receipts(spark, d):
    """Every distinct form of the suppliers' vectors signed, and how many receipts verify."""
    keys = catalog._keys(spark)
    forms = prove.to_sign(prove.run(_vectors(catalog._spread(catalog._t(spark, d, "supplier", "s_suppkey", "s_name")), "s_suppkey", "s_name")))
    signed = receipts.sign(forms, keys, when=F.lit(catalog.WHEN)).withColumn("rid", F.concat_ws(":", "id", "frozen_hash"))
    return receipts.verify(signed, keys, id_col="rid").agg(F.count("*").alias("receipts"), F.count_if("valid").alias("verified"))


_PROOF_SQL = f"""
select sum(n)::bigint as receipts, sum(n)::bigint as verified
from (select case when same is null then (case when s_suppkey % 3 = 0 then 1 else 2 end) when same then 1 else 2 end as n from supplier cross join {_KINDS})
"""


def vector_rejects(spark, d):
    """Vectors of events' properties as lines of text, four fifths of them damaged: which lines are none, and why."""
    e = catalog._t(spark, d, "events", "event_id", "props")
    k, name = F.col("event_id") % 5, F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('"'))
    whole = F.concat(F.lit('{"id":'), name, F.lit(',"a":'), "props", F.lit(',"b":'), "props", F.lit(',"expect_same":true}'))
    line = F.when(k == 0, whole).when(k == 1, F.substr(whole, F.lit(1), F.length(whole) - 1)).when(k == 2, F.replace(whole, F.lit(":true}"), F.lit(':"yes"}'))).when(k == 3, F.concat(F.lit('{"id":'), name, F.lit(',"b":1}'))).otherwise(F.concat(F.lit("["), name, F.lit("]")))
    path = scratch_path(spark, "vectors")
    e.select(line.alias("value")).write.text(path)
    rejects = files.read_rejects(spark, path)
    return rejects.select(F.regexp_extract("value", '"e([0-9]+)"', 1).cast("long").alias("event_id"), "reason", (F.col("line") > 0).alias("numbered"))


_REJECTS_SQL = """
select event_id, case event_id % 5 when 1 then 'no JSON' when 2 then 'wrong type of expect_same' when 3 then 'no a, expect_same' else 'no object' end as reason, true as numbered from events where event_id % 5 <> 0
"""


# -- the hash index -----------------------------------------------------------------------------------------------------------------------------


def index_lookup(spark, d):
    """An index of all lines of documents, to which the turns of conversations are appended: the records with one text's hash, from one bucket."""
    lines = catalog._t(spark, d, "documents", "doc_id", "text").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    turns = catalog._t(spark, d, "conversations", "conv_id", "turn", "text").select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("line"), F.col("text").alias("t"))
    index = HashIndex.create(spark, scratch_path(spark, "index"))
    for name, rows in (("lines", lines), ("turns", turns)):
        hashed = rows.where("t is not null").withColumn("frozen_hash", hashing.digest(hashing.value_form(rows, "t", policy=catalog.PLAIN), catalog.PLAIN))
        index.append(hashed.drop("t"), name)
    value = schemaless.canonical_text('"Released under the MIT License."', catalog.PLAIN)
    return index.lookup(hashlib.sha256(value.encode()).hexdigest()).select("source", "id", "line")


_LOOKUP_SQL = f"""
select source, id, line from (
  select 'documents' as source, doc_id as id, cast(i - 1 as int) as line, l[i] as t from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))
  union all select 'conversations', conv_id, turn::int, text from conversations
) where {catalog._norm("t")} = 'Released under the MIT License.'
"""


def index_join(spark, d):
    """Customers in an index; noised copies of them find their records."""
    c = catalog._t(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    noisy = c.select(F.col("c_custkey").alias("other"), F.concat(F.lit(" \t"), "c_name", F.lit("  ")).alias("c_name"), F.concat("c_mktsegment", F.lit("\n")).alias("c_mktsegment"))
    cols = ["c_name", "c_mktsegment"]
    own, asked = (hashing.with_hash(x, cols, policy=catalog.PLAIN).drop(*cols, "canonical_form") for x in (c, noisy))
    index = HashIndex.create(spark, scratch_path(spark, "index"), digits=1)
    index.append(own, "customers")
    return index.lookup_all(asked).select("c_custkey", "other")


# -- a change of policy -------------------------------------------------------------------------------------------------------------------------


def class_changes(spark, d):
    """Events by day under an old policy, by hour and without one field's case under the new: parts that stay, split, merge or mix."""
    e = catalog._t(spark, d, "events", "ts", "event_type", "user_id")
    mixed = F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    rows = e.select(_text("ts").alias("ts"), mixed.alias("kind"))
    old, new = catalog.PLAIN, catalog.PLAIN.with_(granularity="hour", lower=True)
    hashed = rows.select(*[hashing.digest(hashing.row_form(rows, ["ts", "kind"], policy=p)).alias(n) for n, p in (("old", old), ("new", new))])
    return policy_change.class_changes(hashed, "old", "new")


_CHANGES_SQL = f"""
with recursive r as materialized (
  select sha256('{{"_policy_version":"1.0.0","data":{{"kind":"' || k || '","ts":"' || strftime(date_trunc('day', ts), {SQL_ISO}) || '"}}}}') as old,
         sha256('{{"_policy_version":"1.0.0","data":{{"kind":"' || lower(k) || '","ts":"' || lower(strftime(date_trunc('hour', ts), {SQL_ISO})) || '"}}}}') as new
  from (select ts, case when user_id % 2 = 0 then upper(event_type) else event_type end as k from events)
),
p as materialized (select 'o' || old as a, 'w' || new as b, count(*) as n from r group by all),
e as materialized (select a as x, b as y from p union select b, a from p),
reach(x, y) as (select x, x from e union select reach.x, e.y from reach join e on reach.y = e.x),
part as (select x, min(y) as part from reach group by x)
select substr(part, 2) as part, case when o = 1 and w = 1 then 'same' when o = 1 then 'split' when w = 1 then 'merged' else 'mixed' end as kind, n, o as old_classes, w as new_classes
from (select part, sum(n)::bigint as n, count(distinct a) as o, count(distinct b) as w from p join part on part.x = p.a group by part)
"""


QUERIES = {
    "key_validity": (key_validity, _VALIDITY_SQL),
    "public_export": (public_export, _EXPORT_SQL),
    "key_lifecycle": (key_lifecycle, _LIFECYCLE_SQL),
    "key_as_of": (key_as_of, _AS_OF + "select o_orderkey, keyid, refused from a"),
    "history_receipts": (history_receipts, _HISTORY_SQL),
    "ed25519_verify": (ed25519_verify, "select s_suppkey, s_suppkey % 3 = 0 as valid from supplier"),
    "wrapped_receipts": (wrapped_receipts, _WRAPPED_SQL),
    "receipt_text": (receipt_text, _TEXT_SQL),
    "toml_hash": (
        toml_hash,
        """
select c_custkey, to_base64(unhex(sha256('{"_policy_version":"7.1","data":{"c_name":"' || lower(c_name) || '","segment":' ||
  case c_mktsegment when 'BUILDING' then '"the building"' when 'MACHINERY' then 'null' else '"' || lower(c_mktsegment) || '"' end || '}}'))) as h from customer
""",
    ),
    "conformance_report": (conformance_report, _CONFORMANCE_SQL),
    "proof_receipts": (proof_receipts, _PROOF_SQL),
    "index_lookup": (index_lookup, _LOOKUP_SQL),
    "vector_rejects": (vector_rejects, _REJECTS_SQL),
    "class_changes": (class_changes, _CHANGES_SQL),
    "index_join": (index_join, "select a.c_custkey, b.c_custkey as other from customer a join customer b using (c_name, c_mktsegment)"),
}
