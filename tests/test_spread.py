"""Short rows with much work for each don't stay in one task, and signatures are verified a batch at a time."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from tallyseal.functions import crypto
from tallyseal.operators import verify


@pytest.mark.parametrize("name", ["receipt_report", "wrapped_receipts", "conformance_report"])
def test_small_files_are_dealt(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan


def test_one_batch_of_signatures(monkeypatch):
    seed, calls, whole = bytes(range(32)), [], crypto.ed25519_verify_batch
    key, sig = crypto.ed25519_public(seed), crypto.ed25519_sign(seed, b"m")
    bad = bytes([sig[0] ^ 1]) + sig[1:]
    monkeypatch.setattr(crypto, "ed25519_verify_batch", lambda *a: calls.append(len(a[0])) or whole(*a))
    got = verify._any_signature.func(pd.Series([key, key, None, key, key]), pd.Series([b"m", b"m", b"m", None, b"m"]), pd.Series([[bad, sig], [bad], [sig], [sig], []]))
    assert got.tolist() == [True, False, False, False, False] and calls == [3]
