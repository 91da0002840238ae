"""Audit from the command line: python -m stratalog.cli VERB ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalog.operators import audit, chainfile, oplog, report


def _spark() -> SparkSession:
    return SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()


def _key(path: str | None) -> bytes | None:
    if not path:
        return None
    with open(path, "rb") as f:
        return f.read()


def _body(path: str) -> str:
    with open(path) as f:
        return f.read()


def run(args: argparse.Namespace) -> tuple[object, bool]:
    """What a verb has to say, and whether all is well."""
    verb = args.verb
    if verb == "sign":
        return report.sign(_body(args.report), _key(args.key) or b""), True
    if verb == "verify-sig":
        return "", report.verify_signature(_body(args.report), args.signature, _key(args.key) or b"")
    if verb == "physical":
        log = _spark().read.parquet(args.log)
        rows = [r.asDict() for r in report.physical(log, F.pmod(F.xxhash64("key"), F.lit(args.shards))).orderBy("shard").collect()]  # a row a shard
        return rows, all(r["ordered"] for r in rows)
    if verb == "attest":
        spark = _spark()
        expected, _ = oplog.expectations(oplog.OpLog(spark, args.oplog).read())
        found = report.build(expected, spark.read.parquet(args.live), most_missing=args.most_missing)
        if args.chain:
            chainfile.append(args.chain, found.body())
        return json.loads(found.body()), not found.verdict.startswith("FAIL")
    if verb == "verify":
        given = report.Report(**json.loads(_body(args.report)))
        return report.verdict_of(given), report.verdict_of(given) == given.verdict
    if verb == "chain-verify":
        wrong = chainfile.errors(args.chain)
        if args.anchors and (state := chainfile.anchored(args.chain, args.anchors, _key(args.key))) != "ok":
            wrong.append(state)
        return wrong, not wrong
    if verb == "chain-anchor":
        return chainfile.publish(args.chain, args.anchors, _key(args.key)), True
    # chain-proof: the steps from one entry to the root of its batch
    entries = chainfile.table(_spark(), args.chain).where((F.col("sequence") - 1 >= (args.sequence - 1) // audit.BATCH * audit.BATCH) & (F.col("sequence") - 1 < ((args.sequence - 1) // audit.BATCH + 1) * audit.BATCH))
    leaves = entries.select(F.floor((F.col("sequence") - 1) / audit.BATCH).alias("batch"), ((F.col("sequence") - 1) % audit.BATCH).alias("place"), F.col("hash").alias("h"))
    proof = audit.merkle_proofs(leaves).where(F.col("place") == (args.sequence - 1) % audit.BATCH).first()
    root = audit.merkle_roots(leaves).first()
    return ({"leaf": proof.h, "proof": list(proof.proof), "root": root.root}, True) if proof else ("no such entry", False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratalog", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    options = {
        "sign": ["report", "--key"], "verify-sig": ["report", "signature", "--key"], "physical": ["log", "--shards"], "attest": ["oplog", "live", "--chain", "--most-missing"],
        "verify": ["report"], "chain-verify": ["chain", "--anchors", "--key"], "chain-anchor": ["chain", "anchors", "--key"], "chain-proof": ["chain", "sequence"],
    }
    for verb, names in options.items():
        sub = verbs.add_parser(verb)
        for n in names:
            number = n.lstrip("-") in ("shards", "most-missing", "sequence")
            sub.add_argument(n, **({"type": int} if number else {}), **({"default": {"--shards": 4, "--most-missing": 0}.get(n)} if n.startswith("--") else {}))
    return top


def main(argv: list[str] | None = None) -> int:
    said, well = run(parser().parse_args(argv))
    print(said if isinstance(said, str) else json.dumps(said))
    return 0 if well else 1


if __name__ == "__main__":
    sys.exit(main())
