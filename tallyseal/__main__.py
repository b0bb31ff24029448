"""Commands: prove (a conformance run) and verify (receipts in files). Exit code 0 if all holds, 1 if not, 2 for wrong usage or unreadable input."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyseal.operators import keys as K
from tallyseal.operators import prove as P
from tallyseal.operators import verify as V
from tallyseal.plans import policy
from tallyseal.sources import files


#: Malformed lines told on standard error.
MOST_WARNINGS = 20


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyseal", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("prove", help="run sameness vectors, sign and verify their hashes")
    c.add_argument("--vectors", required=True, help="JSON lines")
    c.add_argument("--policy", help="TOML file")
    c.add_argument("--vector", help="only the vector with this id")
    c.add_argument("--no-sign", action="store_true")
    c.add_argument("--keys", help="registry file whose active key signs; without it a new key does")
    c.add_argument("--keyid", help="another key of the registry")
    c.add_argument("--evidence-dir", help="results, receipts, manifest and summary go there")
    c.add_argument("--verbose", action="store_true", help="a line a vector")
    c = commands.add_parser("verify", help="check receipts, one a file")
    c.add_argument("paths", nargs="+")
    c.add_argument("--key", help="hex public key to trust instead of the receipt's own")
    c.add_argument("--namespace", default=V.NAMESPACE)
    c.add_argument("--json", action="store_true", help="a JSON object a receipt")
    return p


def _prove(spark: SparkSession, a: argparse.Namespace) -> int:
    rules = policy.load(a.policy) if a.policy else policy.DEFAULT
    vectors = files.read_vectors(spark, a.vectors)
    if a.keyid and not a.keys:
        raise ValueError("--keyid names a key of --keys")
    keys = None
    if a.keys:
        keys = None if a.no_sign else files.read_keys(spark, a.keys)
    elif not a.no_sign:
        registry = K.Registry()
        registry.generate_hmac("run")
        keys = registry.table(spark)
    rejects = files.read_rejects(spark, a.vectors).orderBy("file", "line").limit(MOST_WARNINGS + 1).collect()
    for r in rejects[:MOST_WARNINGS]:
        print(f"tallyseal: {r['file']}:{r['line']}: {r['reason']}", file=sys.stderr)
    if len(rejects) > MOST_WARNINGS:
        print("tallyseal: and more malformed lines", file=sys.stderr)
    n = P.prove(vectors, keys, a.keyid, only=a.vector, policy=rules, out=a.evidence_dir)
    if a.verbose:
        for r in P.run(vectors, rules, a.vector).select("id", "description", "passed").toLocalIterator():
            print(f"{'pass' if r['passed'] else 'FAIL'} {r['id']} {r['description']}")
    print(P.summary(n))
    return 0 if n["ok"] else 1


def _verify(spark: SparkSession, a: argparse.Namespace) -> int:
    found = files.read_receipts(spark, a.paths).withColumn("key", F.lit(a.key).cast("string"))
    reported = V.report(found, key_col="key", namespace=a.namespace)
    lines = V.report_json(reported) if a.json else V.report_text(reported)
    for r in lines.toLocalIterator():
        print(r["value"])
    total, valid = reported.agg(F.count("*"), F.count_if("valid")).first()
    return 0 if total and total == valid else 1


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return {"prove": _prove, "verify": _verify}[a.command](spark, a)
    except (OSError, ValueError, PySparkException) as e:
        print(f"tallyseal: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
