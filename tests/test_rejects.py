import json
import random

from tallyseal import __main__ as cli
from tallyseal.operators import keys as K
from tallyseal.sources import files

GOOD = json.dumps({"id": "v", "a": {"x": 1}, "b": {"x": 1}, "expect_same": True})
BAD = {
    "{": "no JSON", "[1]": "no object", "null": "no object", '{"id":"x"}': "no a, b, expect_same", '{"id":1,"a":1,"b":1,"expect_same":true}': "wrong type of id", '{"id":"x","a":1,"b":1,"expect_same":"yes"}': "wrong type of expect_same",
    '{"id":"x","a":1,"b":1,"expect_same":true,"set_fields":"t"}': "wrong type of set_fields", '{"id":"x","a":1,"b":1,"expect_same":true,"set_fields":[1],"description":2}': "wrong type of description, set_fields", "é": "no JSON", "[" * 100_000: "no JSON",
}


def test_rejects_have_their_numbers_in_every_block(spark, tmp_path):
    rng = random.Random(1)
    want = set()
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 7), ("c.jsonl", 0)):
        lines = [rng.choice([GOOD, GOOD, "", "  ", *list(BAD)[:9]]) for _ in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + "\n" * (n > 10), encoding="utf-8")
        want |= {(name, k, BAD[x], x) for k, x in enumerate(lines, 1) if x in BAD}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = files.read_rejects(spark, f"file://{tmp_path}").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {(r["file"].rsplit("/", 1)[-1], r["line"], r["reason"], r["value"]) for r in rows} == want and len(rows) == len(want)


def test_vectors_leave_rejects_out(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text("\n".join([GOOD, *BAD, "", GOOD.replace('"v"', '"w"')]), encoding="utf-8")
    assert [r["id"] for r in files.read_vectors(spark, f"file://{tmp_path}/v.jsonl").collect()] == ["v", "w"]
    assert sorted(r["reason"] for r in files.read_rejects(spark, f"file://{tmp_path}/v.jsonl").collect()) == sorted(BAD.values())
    assert files.read_vectors(spark, f"file://{tmp_path}/v.jsonl").columns == files.VECTOR.names


def test_prove_signs_with_a_stored_registry_and_warns(spark, tmp_path, capsys):
    path, vectors = str(tmp_path / "keys.json"), str(tmp_path / "v.jsonl")
    registry = K.Registry(path)
    registry.generate_hmac("old")
    registry.rotate("new")
    (tmp_path / "v.jsonl").write_text(GOOD + "\n{\n" + GOOD + "\n")
    out = str(tmp_path / "out")
    assert cli.main(["prove", "--vectors", vectors, "--keys", path, "--evidence-dir", out]) == 0
    assert "v.jsonl:2: no JSON" in capsys.readouterr().err
    assert {r["signatures"][0]["keyid"] for r in spark.read.json(f"{out}/receipts").collect()} == {"new"}
    assert cli.main(["prove", "--vectors", vectors, "--keys", path, "--keyid", "old"]) == 2  # at rest since the rotation
    assert cli.main(["prove", "--vectors", vectors, "--keyid", "old"]) == 2
    assert cli.main(["prove", "--vectors", vectors, "--keys", str(tmp_path / "none.json")]) == 2
