import base64
import random

import pytest
from pyspark.sql import functions as F

from tallyseal.functions import crypto
from tallyseal.operators import key_history as H
from tallyseal.operators import keys as K

EVENTS = "issuer string, at string, event string, keyid string, algorithm string, expires_utc string, hmac_secret_b64 string, public_key_pem string"


def when(day, second=0):
    return f"2024-{1 + day // 28:02}-{1 + day % 28:02}T00:00:{second:02}Z"


def secret(name):
    return base64.b64encode(name.encode()).decode()


@pytest.fixture(scope="module")
def log():
    rng = random.Random(6)
    rows = []
    for issuer in ("a", "b", "hot"):
        for k in range(40 if issuer == "hot" else 6):
            day = rng.randrange(300)
            rows.append((issuer, when(day), rng.choice(["create", "rotate", "rotate"]), f"{issuer}{k}", K.HMAC, rng.choice([None, "", when(day + 20)]), secret(f"{issuer}{k}"), None))
            if rng.random() < 0.3:
                rows.append((issuer, when(day + rng.randrange(30)), "revoke", f"{issuer}{k}", None, None, None, None))
            if rng.random() < 0.5:
                rows.append((issuer, when(rng.randrange(330)), "use", f"{issuer}{k}", None, None, None, None))
    return rows + [("a", when(5), "rotate", "tie1", K.HMAC, None, secret("1"), None), ("a", when(5), "rotate", "tie2", K.HMAC, None, secret("2"), None), ("a", when(9), "rotate", "tie2", K.HMAC, when(1), secret("x"), None), ("b", when(50), "use", "never made", None, None, None, None), ("b", when(50), "strange", "b0", None, None, None, None), (None, when(3), "rotate", "n", K.HMAC, None, None, None), ("c", None, "rotate", "c0", K.HMAC, None, None, None)]


def plain_keys(log):
    out = {}
    for issuer, keyid in {(r[0], r[3]) for r in log}:
        own = [r for r in log if (r[0], r[3]) == (issuer, keyid)]
        made = [r for r in own if r[2] in H.MADE]
        if made:
            first = min(made, key=lambda r: (r[1] is not None, r[1] or "", r[4] or "", r[5] is not None, r[5] or ""))
            out[issuer, keyid] = (first[1], first[5], min((r[1] for r in own if r[2] == "revoke"), default=None))
    return out


def plain_key_at(log, keys, issuer, at):
    if issuer is None or at is None:
        return None
    used = [(r[1], r[3]) for r in log if r[0] == issuer and r[1] is not None and r[2] in ("rotate", "use") and (issuer, r[3]) in keys and keys[issuer, r[3]][0] is not None and r[1] >= keys[issuer, r[3]][0] and r[1] <= at]
    return max(used)[1] if used else None


@pytest.mark.parametrize("span", [H.DAY, 40 * H.DAY, 10_000 * H.DAY])
def test_signing_key_equals_brute_force(spark, log, span):
    rng = random.Random(8)
    rows = [(k, rng.choice(["a", "b", "hot", "hot", "hot", "none", None]), rng.choice([None, *[when(rng.randrange(330), rng.choice((0, 1))) for _ in range(9)]])) for k in range(500)]
    rows += [rows[0], rows[0]]
    keys = plain_keys(log)
    df = spark.createDataFrame(rows, "id long, who string, at string").repartition(3)
    got = H.signing_key(df, spark.createDataFrame(log, EVENTS), at="at", issuer="who", span=span).collect()
    assert got[0].asDict().keys() == {"who", "id", "at", "keyid", "refused"} and len(got) == len(rows)
    want = {}
    for k, issuer, at in rows:
        key = plain_key_at(log, keys, issuer, at)
        why = "no key in use"
        if key:
            made, ends, gone = keys[issuer, key]
            why = f"signed after revocation at {gone}" if gone and at >= gone else f"signed after expiry at {ends}" if ends and at >= ends else None
        want[k] = (key, why)
    assert {r["id"]: (r["keyid"], r["refused"]) for r in got} == want and len({v for v in want.values()}) > 20


def test_fold_keeps_the_first_making(spark, log):
    got = {(r["issuer"], r["keyid"]): (r["created_utc"], r["expires_utc"], r["revoked_utc"]) for r in H.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == plain_keys(log)


def test_as_of_refuses_clashes_and_takes_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01T00:00:00Z")], "id long, by string, t string")
    changes = spark.createDataFrame([], "by string, at string, id long")
    with pytest.raises(ValueError, match="id"):
        H.as_of(rows, changes, by=["by"], at="t", changed="at", take=["id"], tie="id")
    none = H.as_of(rows, changes.withColumnRenamed("id", "x"), by=["by"], at="t", changed="at", take=["x"], tie="x")
    assert [tuple(r) for r in none.collect()] == [(1, "a", "2024-01-01T00:00:00Z", None)]
    assert H.as_of(rows.limit(0), changes.withColumnRenamed("id", "x"), by=["by"], at="t", changed="at", take=["x"], tie="x").collect() == []


def test_no_pairs_are_made(spark, log):
    df = spark.createDataFrame([(1, "a", when(3))], "id long, who string, at string")
    plan = H.signing_key(df, spark.createDataFrame(log, EVENTS), at="at", issuer="who")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Generate" not in plan


@pytest.mark.parametrize("broadcast", [True, False])
def test_receipts_hold_by_the_times_of_their_keys(spark, monkeypatch, broadcast):
    monkeypatch.setattr(K, "BROADCAST_KEYS", 10_000 if broadcast else 0)
    private, public = crypto.p256_generate(11)
    log = [("a", when(0), "rotate", "k", K.HMAC, when(100), secret("k"), None), ("a", when(60), "revoke", "k", None, None, None, None), ("a", when(0), "create", "curve", K.ECDSA, None, None, public), ("a", when(0), "create", "rsa", "RSA", None, None, None)]
    keys = H.fold(spark.createDataFrame(log, EVENTS))
    rows = [(k, "a", "k", f"h{k}", f"f{k}", t) for k, t in enumerate((when(10), when(59, 59), when(60), when(120), "2023-01-01T00:00:00Z"))] + [(9, "a", "other", "h", "f", when(1)), (10, "b", "k", "h", "f", when(1))]
    df = spark.createDataFrame(rows, "id long, issuer string, keyid string, frozen_hash string, canonical_form string, t string")
    signed = H.sign_each(df, keys, at="t", receipt_id=F.concat(F.lit("r"), F.col("id").cast("string"))).cache()
    assert {r["id"] for r in signed.where("envelope is null").collect()} == {9, 10}

    def judged(x):
        return {r["id"]: (r["valid"], r["reason"]) for r in H.verify_at(x, keys).collect()}

    got = judged(signed)
    assert got[0] == got[1] == (True, "Signature valid") and got[2] == (False, f"k: signed after revocation at {when(60)}") and got[3][1].startswith("k: signed after revocation")
    assert got[4] == (False, "k: signed before the key was made") and got[9] == (False, "Undecodable payload")
    e = F.col("envelope")

    def moved(*sigs):
        return signed.where("id = 0").withColumn("envelope", F.struct(e["payloadType"].alias("payloadType"), e["payload"].alias("payload"), F.array(*[F.struct(k.alias("keyid"), s.alias("sig")) for k, s in sigs]).alias("signatures")))

    good, wrong = e["signatures"][0]["sig"], F.lit("AAAA")
    assert judged(moved((F.lit("no"), good), (F.lit("k"), wrong), (F.lit("k"), good))) == {0: (True, "Signature valid")}
    assert judged(moved((F.lit("no"), good), (F.lit("k"), wrong), (F.lit("rsa"), good))) == {0: (False, "no: not found in history; k: signature mismatch; rsa: unknown algorithm RSA")}
    from tallyseal.functions import encoding

    message = encoding.pae(e["payloadType"], encoding.from_b64(e["payload"]))
    by_curve = encoding.b64url(crypto.p256_signature(F.lit(private), message))
    assert judged(moved((F.lit("curve"), by_curve))) == {0: (True, "Signature valid")} and judged(moved((F.lit("curve"), good))) == {0: (False, "curve: signature mismatch")}
