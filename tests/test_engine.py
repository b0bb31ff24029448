import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyseal.functions import crypto, encoding, numbers, schemaless, strings, timestamps
from tallyseal.operators import hashing, prove, receipts, sameness, verify
from tallyseal.operators import keys as K
from tallyseal.plans import compiler, policy
from tallyseal.sources import files
from tallyseal.streaming import streams

P = policy.DEFAULT


@pytest.mark.parametrize(
    ("text", "sets", "start"),
    [
        ('{"b":1.50,"A":"  x \\t y ","request_id":"r1","n":null}', (), "29f41871d66b809e"),
        ('{"at":true,"l":[null,2,""]}', (), "9627c242e08cf482"),
        ('{"created_at":"2024-03-01T23:30:00-02:00","timestamp":"x"}', (), "83e501d16c814b0d"),
        ('{"ts":"2024-03-01T10:00:00"}', (), "51d09a8d507063b7"),
        ('"d\\u00e9j\\u00e0 vu"', (), "2d664c49a5480dae"),
        ('{"s":["a","a b"]}', ("s",), "f0939e8e2bd159d7"),
    ],
)
def test_pinned_hashes(text, sets, start):
    assert hashlib.sha256(schemaless.canonical_text(text, P, frozenset(sets)).encode()).hexdigest().startswith(start)


def test_typed_equals_schemaless(spark):
    rng = random.Random(5)
    words = ["U.S. port", " a b ", "é x", "USſ", "\U0001f600\"\\", "", "2024-02-03T04:05:06+01:00", "mUSEum", "Made in U.S.A."]
    rows = []
    for k in range(120):
        pick = lambda: rng.choice([*words, None])
        rows.append((k, pick(), pick(), rng.choice([None, 0.1, -0.0, 1e22, 2.5, 1e-7, 3.0]), rng.choice([None, 7, -3]), rng.choice([None, True]), [pick() for _ in range(3)], [(pick(), rng.choice([1.5, None]))], {rng.choice(words) or "k": pick(), "nonce": "n"}, pick()))
    schema = "id long, `b c` string, created_at string, v double, i int, t boolean, tags array<string>, subs array<struct<z:string,a:double>>, m map<string,string>, `x-request-id` string"
    df = spark.createDataFrame(rows, schema)
    cols = [c for c in df.columns if c != "id"]
    for p, sets in ((P, ("tags",)), (P.with_(synonyms=(), dedup_sets=True, granularity="second", lower=True), ("tags", "subs")), (P.with_(unicode_form="NFKC", timestamps="strip", remove_empty=True), ())):
        got = {r["id"]: r["cf"] for r in df.select("id", hashing.row_form(df, cols, policy=p, set_fields=sets).alias("cf")).collect()}
        for r in rows:
            value = dict(zip(["id", *cols], r, strict=True))
            value.pop("id")
            value["subs"] = [{"z": z, "a": a} for z, a in value["subs"]]
            assert got[r[0]] == schemaless.canonical_text(json.dumps(value), p, frozenset(sets))


def test_metamorphic():
    base = {"a": [1, "x y"], "b": {"c": 2.50, "d": None}, "date": "2024-01-02T03:04:05Z"}
    h = lambda x: schemaless.canonical_text(json.dumps(x), P)
    assert h(base) == h({"date": "2024-01-02T23:00:00Z", "b": {"c": 2.5}, "a": [1.0, " x\n y"], "nonce": 4})
    assert h(base) != h(base | {"a": ["x y", 1]})


def test_numbers(spark):
    for x, text in ((1, "1"), (-0.0, "0"), (1e22, "10000000000000000000000"), (1e-7, "0.0000001"), (8.41e21, "8410000000000000000000"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (10**30 + 1, "1" + "0" * 30)):
        assert numbers.number_text(x) == text
    df = spark.createDataFrame([(2e23, 1.10), (0.1, 100.0), (None, None)], "d double, f double").withColumn("e", F.col("f").cast("decimal(20,4)"))
    kinds = {f.name: f.dataType for f in df.schema}
    got = [tuple(r) for r in df.select(*[numbers.canonical_number(F.col(c), kinds[c]) for c in "dfe"]).collect()]
    assert got == [("200000000000000000000000", "1.1", "1.1"), ("0.1", "100", "100"), (None, None, None)]


def test_timestamps(spark):
    texts = ["2024-03-01T23:30:00-02:00", "2024-03-01t1:2:3z", "2024-02-30", "2024-1-1 10:00:00", "2024-01-01T00:00:00.1234567Z", "2024-01-01T00:00:60Z", " 2024-01-01", "2024-01-01T10:00:00.5+0530", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for g in ("day", "hour", "minute", "second", "other"):
        for r in df.select("t", timestamps.bucket_text(timestamps.parse(F.col("t")), g).alias("b")).collect():
            assert r["b"] == (timestamps.py_bucket(r["t"], g) if r["t"] is not None else None)


def test_policy_file():
    p = policy.from_toml('policy_version = "2"\n[hash]\nalgorithm = "SHA-512"\noutput_encoding = "base64"\n[timestamp_normalization]\nmode = "strip"\n[synonyms]\nenabled = true\n[synonyms.mappings]\nUS = "A"\nus = "B"\n')
    assert (p.version, p.bits, p.timestamps, p.rules()) == ("2", 512, "strip", [("us", "B")])
    for bad in ('policy_version = "2"\n[hash]\nalgorithm = "SHA3-256"\n', 'policy_version = "2"\n[other]\nx = 1\n', 'policy_version = "2"\n[hash]\nx = 1\n'):
        with pytest.raises(ValueError, match="."):
            policy.from_toml(bad)


def test_same_name_keys(spark):
    df = spark.createDataFrame([("x", "y"), ("x", None)], "`a  b` string, `a b` string")
    rows = [r[0] for r in df.select(hashing.row_form(df, policy=P, bind=False)).collect()]
    assert rows == ['{"a b":"y"}', '{"a b":"x"}']
    assert compiler.normal_name(" a\tb ", P) == "a b"


def test_keys(tmp_path):
    path = str(tmp_path / "keys.json")
    r = K.Registry(path)
    r.generate_hmac("a", secret=b"s")
    sig = r.sign("a", b"m")
    r.rotate("b", algorithm=K.ECDSA)
    assert r.active == "b" and r.verify("a", b"m", sig) and not r.verify("a", b"n", sig)
    with pytest.raises(ValueError, match="valid"):
        r.sign("a", b"m")
    with pytest.raises(ValueError, match="exists"):
        r.rotate("a")
    assert r.get("b").active
    again = K.Registry(path)
    assert again.verify("b", b"m", again.sign("b", b"m")) and [k.keyid for k in again.list()] == ["a", "b"]
    public = K.Registry.from_public(r.export_public(str(tmp_path / "public.json")))
    assert public.verify("b", b"m", r.sign("b", b"m")) and not public.verify("a", b"m", sig)
    public.load_secret("a", b"s")
    assert public.verify("a", b"m", sig)
    r.revoke("b")
    assert r.active is None and r.get_valid("b") is None and not r.verify("b", b"m", b"")
    assert K.Key("x", K.HMAC, "t", expires_utc="2024-01-02T00:00:00Z").valid_at("2024-01-01T00:00:00Z")


def test_published_crypto_vectors(spark):
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert crypto.ed25519_public(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert crypto.ed25519_sign(seed, b"").hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert crypto.ed25519_verify(crypto.ed25519_public(seed), b"", crypto.ed25519_sign(seed, b"")) and not crypto.ed25519_verify(crypto.ed25519_public(seed), b"x", crypto.ed25519_sign(seed, b""))
    df = spark.createDataFrame([(b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First")], "k binary, m binary")
    got = [r[0][:16] for r in df.select(encoding.hmac_sha256(encoding.hmac_pads(F.col("k")), F.col("m"))).collect()]
    assert got == ["b0344c61d8db3853", "5bdcc146bf60754e", "60e431591ee0b67f"]


def test_receipts_and_proof(spark, tmp_path):
    r = K.Registry()
    r.generate_hmac("k", secret=b"s" * 32)
    path = tmp_path / "v.jsonl"
    path.write_text('\n{"id":"1","a":" x ","b":"x","expect_same":true}\nbroken\n{"id":"2","a":{"t":["b","a"]},"b":{"t":["a","b"]},"expect_same":true,"set_fields":["t"]}\n{"id":"3","a":1,"b":2,"expect_same":true}\n')
    v = files.read_vectors(spark, str(path))
    n = prove.prove(v, r.table(spark), "k", out=str(tmp_path / "out"))
    assert (n["total"], n["passed"], n["receipts"], n["receipts_valid"], n["ok"]) == (3, 2, 4, 4, False)
    assert spark.read.json(str(tmp_path / "out/manifest")).count() == 4
    signed = receipts.sign(prove.to_sign(prove.run(v)), r.table(spark), "k").withColumn("id", F.monotonically_increasing_id())
    back = signed.select("id", receipts.parse_envelope(receipts.envelope_json(F.col("envelope"))).alias("envelope"))
    assert receipts.verify(back, r.table(spark)).where("valid").count() == 4
    e = F.col("envelope")
    broken = back.withColumn("envelope", F.struct(e["payloadType"].alias("payloadType"), F.lit("*").alias("payload"), e["signatures"].alias("signatures")))
    assert {x["reason"] for x in receipts.verify(broken, r.table(spark)).collect()} == {"Undecodable payload"}


def _key_rows(spark, *rows):
    """(keyid, algorithm, expires, revoked, active, secret, private, public, current)."""
    import base64

    full = [(k, a, "2024-01-01T00:00:00Z", e, r, on, base64.b64encode(s).decode() if s else None, None, private, public, now) for k, a, e, r, on, s, private, public, now in rows]
    return spark.createDataFrame(full, K.SCHEMA)


def test_receipts_are_judged_row_by_row(spark):
    """Repeated and null ids, a forged twin, several signatures; with keys sent out and with keys joined."""
    private, public = crypto.p256_generate(7)
    keys = _key_rows(spark, ("h", K.HMAC, None, None, True, b"s" * 32, None, None, True), ("e", K.ECDSA, None, None, True, None, private, public, False), ("x", "RSA", None, None, True, None, None, None, False))
    base = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, "d")], "id long, canonical_form string").withColumn("frozen_hash", F.sha2("canonical_form", 256))
    signed = receipts.sign(base, keys).select("id", "canonical_form", "envelope").collect() + receipts.sign(base, keys, "e").select("id", "canonical_form", "envelope").collect()
    e = [r["envelope"] for r in signed]
    env = lambda x, *sigs: (x["payloadType"], x["payload"], [tuple(s) for s in sigs])
    good = [(r["id"], env(r["envelope"], *r["envelope"]["signatures"])) for r in signed]
    h, ec = e[0]["signatures"][0], e[4]["signatures"][0]
    more = [
        (1, env(e[0], ("h", "AAAA"))), (None, env(e[0], ("h", None))), (1, env(e[0], ("x", "AAAA"), ("nobody", h["sig"]), ("e", h["sig"]), tuple(h))), (3, env(e[0], ("e", "!"), (None, "AAAA"))),
        (3, ("other", e[0]["payload"], [tuple(h)])), (3, (e[0]["payloadType"], e[0]["payload"], None)), (3, (e[0]["payloadType"], "e30", [tuple(h)])), (3, env(e[5], tuple(ec))), (3, None),
    ]
    df = spark.createDataFrame(good + more, f"id long, envelope {receipts.ENVELOPE}")
    want = [(r["id"], True, r["envelope"]["signatures"][0]["keyid"], "Signature valid") for r in signed] + [
        (1, False, None, "h: signature mismatch"), (None, False, None, "h: signature mismatch"), (1, True, "h", "Signature valid"), (3, False, None, "e: signature mismatch; : not found in registry"),
        (3, False, None, "Unexpected payloadType: other"), (3, False, None, "No signatures in envelope"), (3, False, None, "Malformed payload"), (3, False, None, "e: signature mismatch"), (3, False, None, "Undecodable payload"),
    ]
    for most in (10, 1):
        got = [tuple(r) for r in receipts.verify(df, keys, most_keys=most).select("id", "valid", "keyid", "reason").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = receipts.verify(df, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_signers_that_may_not_sign(spark):
    past = "2024-02-01T00:00:00Z"
    keys = _key_rows(
        spark, ("gone", K.HMAC, None, past, False, b"s", None, None, False), ("old", K.HMAC, past, None, True, b"s", None, None, False), ("rested", K.HMAC, None, None, False, b"s", None, None, False),
        ("odd", "RSA", None, None, True, None, None, None, False), ("twice", K.HMAC, None, None, True, b"s", None, None, False), ("twice", K.HMAC, None, None, True, b"t", None, None, False),
    )
    df = spark.createDataFrame([("f", "c", "2024-01-05T00:00:00Z")], "frozen_hash string, canonical_form string, t string")
    for name in ("gone", "old", "rested", "odd", "twice", "nobody", None):
        with pytest.raises(ValueError, match="key"):
            receipts.sign(df, keys, name)
    assert receipts.sign(df, keys, "old", at="2024-01-05T00:00:00Z", when=F.col("t")).count() == 1  # times may come from a column


def test_key_tables_and_reports_as_files(spark, tmp_path):
    r = K.Registry(str(tmp_path / "keys.json"))
    r.generate_hmac("a", secret=b"s" * 32)
    r.generate_ecdsa("b", use=False)
    keys = files.read_keys(spark, str(tmp_path / "keys.json"))
    assert {x["keyid"]: x["current"] for x in keys.collect()} == {"a": True, "b": False} and receipts.signer(keys) == ("a", K.HMAC)
    files.write_public_keys(keys, str(tmp_path / "public"))
    public = spark.read.json(str(tmp_path / "public"))
    assert {x["keyid"]: x["hmac_fingerprint"] for x in public.collect()} == {"a": hashlib.sha256(b"s" * 32).hexdigest()[:16], "b": None} and "hmac_secret_b64" not in public.columns
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text('{"canon_version": 1,\n"n": 2}')
    assert [x["receipt"] for x in files.read_receipts(spark, str(tmp_path / "r")).collect()] == ['{"canon_version": 1,\n"n": 2}']


def test_commands(spark, tmp_path, capsys):
    from tallyseal.__main__ import main
    from tallyseal.plans import receipt_queries

    v = tmp_path / "v.jsonl"
    v.write_text('{"id":"1","a":" x ","b":"x","expect_same":true}\n{"id":"2","a":1,"b":2,"expect_same":true}\n')
    assert main(["prove", "--vectors", str(v), "--verbose"]) == 1 and "FAIL 2" in capsys.readouterr().out
    assert main(["prove", "--vectors", str(v), "--vector", "1", "--evidence-dir", str(tmp_path / "out")]) == 0
    assert main(["prove", "--vectors", str(v), "--vector", "1", "--no-sign"]) == 0 and "Receipts: 0 of 0" in capsys.readouterr().out
    assert main(["prove", "--vectors", str(tmp_path / "none")]) == 2
    rows = {f"{k}.json": receipt_queries._receipt(k, "n") for k in (0, 1, 2, 3, 5)}
    for name, text in rows.items():
        (tmp_path / name).write_text(text)
    key, path = crypto.ed25519_public(receipt_queries.SEED).hex(), lambda k: str(tmp_path / f"{k}.json")
    assert main(["verify", "--key", key, *map(path, (0, 1, 2, 3))]) == 0 and capsys.readouterr().out.count("VALID") == 4
    assert main(["verify", path(5)]) == 1 and "[FAIL] signature" in capsys.readouterr().out
    assert main(["verify", "--json", path(1)]) == 0 and json.loads(capsys.readouterr().out)["valid"]
    assert main(["verify", path(0)]) == 1 and main(["verify", path(77)]) == 2
    with pytest.raises(SystemExit):
        main(["verify"])


def test_chains_and_ranks(spark):
    df = spark.createDataFrame([("s", 1, "a", None), ("s", 2, "b", "a"), ("s", 3, "c", "x"), ("t", 1, "d", None)], "k string, n int, own string, prior string")
    assert [r["own"] for r in receipts.chain_breaks(df, "k", "n", "own", "prior").collect()] == ["c"]
    ranked = sameness.rank_in_class(df.withColumn("frozen_hash", F.col("k")), "n").collect()
    assert sorted((r["own"], r["place"]) for r in ranked) == [("a", 1), ("b", 2), ("c", 3), ("d", 1)]


def test_verifier_formats(spark):
    seed = bytes(32)
    key = crypto.ed25519_public(seed).hex()
    body = {"canon_version": 1, "n": None, "é": 1}
    sig = crypto.ed25519_sign(seed, verify.canonical_bytes(body)).hex()
    legacy = body | {"signer": key, "signature": sig, "payload_hash": "a" * 64, "receipt_coord": "b" * 32}
    core_body = {"receipt_type": "evaluation", "io_integrity_score": 0.5}
    core = core_body | {"signer": key, "signature": crypto.ed25519_sign(seed, verify.canonical_bytes(core_body)).hex(), "payload_hash": "a" * 64, "receipt_coord": "seal:" + "b" * 32}
    text, domain = '{"a":1}', "d:v1"
    env = {f: "x" for f in verify.REQUIRED} | {"envelope_version": "1", "receipt_id": "sha256:" + "c" * 64, "canonical_payload": text, "payload_hash": "sha256:" + hashlib.sha256(text.encode()).hexdigest(), "signing_domain": domain, "signer_public_key": key, "signature_algorithm": "Ed25519", "receipt_type": "witness", "extensions": {verify.NAMESPACE: {"spatial_action": "x"}}}
    env["signature"] = crypto.ed25519_sign(seed, f"{domain}\n{text}".encode()).hex()
    import base64

    data = b'{"receipt_type":"output"}'
    pae = b"DSSEv1 %d %s %d %s" % (len(verify.DSSE_TYPE), verify.DSSE_TYPE.encode(), len(data), data)
    dsse = {"dsse_envelope": {"payloadType": verify.DSSE_TYPE, "payload": base64.b64encode(data).decode(), "signatures": [{"keyid": "k", "sig": base64.urlsafe_b64encode(crypto.ed25519_sign(seed, pae)).decode()}]}}
    cases = {"legacy": legacy, "core": core, "env": env, "dsse": dsse, "wrapped": {"receipt": env, "x": 1}, "demo": {"receipt": legacy, "demo": 1}, "bad_sig": legacy | {"signature": "zz"}, "bad_text": env | {"canonical_payload": text + " "}, "empty": {}, "no_ext": env | {"extensions": {}}}
    df = spark.createDataFrame([(k, json.dumps(v), key) for k, v in cases.items()] + [("junk", "{", key), ("null", None, key)], "id string, receipt string, k string")
    got = {r["id"]: r for r in verify.report(df, key_col="k").collect()}
    assert {k for k, r in got.items() if r["valid"]} == {"legacy", "core", "env", "dsse", "wrapped", "demo"}
    assert got["core"]["claims"] == {"io_integrity_score": "0.5"} and got["dsse"]["receipt_type"] == "output" and got["no_ext"]["errors"]
    own = {r["id"]: r for r in verify.report(df).collect()}
    assert own["env"]["valid"] and own["env"]["key_source"] == "receipt" and not own["dsse"]["valid"]
    assert verify.report_text(verify.report(df)).where("value like '%VALID%'").count() == len(cases) + 2


def test_unicode_space_and_escape(spark):
    text = "\x1c a\x85　b​\x7fé\U0001f600\t\"\\"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    rows = df.select(strings.collapse(strings.trim(F.col("t"))).alias("n"), strings.json_text(F.col("t")).alias("j")).collect()
    import re

    assert rows[0]["n"] == re.sub(r"\s+", " ", text.strip()) and rows[0]["j"] == json.dumps(text) and rows[1]["j"] is None
    texts = [text, "plain", 'q"\\\n\r\t\b\f', "\x01\x0b\x1f\x7f", "", "\\u0041", None]
    more = spark.createDataFrame([(x,) for x in texts], "t string")
    for native in (False, True):
        assert [r[0] for r in more.select(strings.json_text(F.col("t"), native=native)).collect()] == [None if x is None else json.dumps(x) for x in texts]
    assert [r[0] for r in more.select(strings.json_normal(F.col("t"), P)).collect()] == [None if x is None else json.dumps(schemaless.normalize(x, P)) for x in texts]


def test_sameness(spark):
    df = spark.createDataFrame([(1, "x"), (2, " x"), (3, "y")], "id long, t string")
    h = hashing.with_hash(df, ["t"])
    assert sorted(r["id"] for r in sameness.keep_first(h, "id").collect()) == [1, 3]
    assert sorted(r["n"] for r in sameness.classes(h, "id").collect()) == [1, 2]
    assert sameness.match(h, h.select("frozen_hash")).count() == 5


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (2, " x ", "2024-01-01 00:10:00"), (3, "y", "2024-01-01 00:20:00")], "id long, t string, at string").selectExpr("id", "t", "cast(at as timestamp) as at").write.parquet(src)
    stream = spark.readStream.schema("id long, t string, at timestamp").parquet(src)
    q = streams.first_seen(streams.frozen(stream, ["t"]), "at").writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("seen").select("frozen_hash").distinct().count() == spark.table("seen").count() == 2
