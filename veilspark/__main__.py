"""python -m veilspark COMMAND PATH: profile, risk, tokenise, redact, flatten, audit."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .operators import ledger, mask, policy, profile, risk
from .operators.vault import Vault
from .plans import sandbox
from .sources import readers, sinks


def main() -> None:
    ask = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    ask.add_argument("command", choices="profile risk tokenise redact flatten audit".split())
    ask.add_argument("path", help="a table; for audit, a Python script")
    ask.add_argument("--out", help="where the result goes; shown if it isn't given")
    ask.add_argument("--origin", default="Universal")
    ask.add_argument("--target", default="Universal")
    given = ask.parse_args()
    if given.command == "audit":
        with open(given.path) as f:
            found = sandbox.findings(f.read())
        print("\n".join(found) or "nothing to object to")
        raise SystemExit(bool(found))
    spark = SparkSession.builder.appName("veilspark").getOrCreate()
    df = readers.read(spark, given.path, ordered=given.command == "flatten")
    if given.command == "profile":
        df = profile.profile(df)
    elif given.command == "risk":
        df = risk.summary(df, risk.resolve_quasi_identifiers(df), policy.sensitive_column(df.columns))
    elif given.command == "tokenise":
        df = Vault.build([df], policy.resolve(given.origin, given.target)).tokenise(df)
    elif given.command == "redact":
        for c in [c for c, t in df.dtypes if t == "string"]:
            df = df.withColumn(c, mask.redact(df[c]))
    else:
        df = ledger.clean(df)
    if given.out:
        sinks.write(df, os.path.expanduser(given.out))
    else:
        df.show(100, truncate=80)


if __name__ == "__main__":
    main()
