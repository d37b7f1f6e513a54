"""python -m lacuna.cli COMMAND --scores PATH ...: audit, validate, list-models, list-evaluations, predict, complete-model, add-model, impute."""

from __future__ import annotations

import argparse
import json
import sys

from lacuna import product
from lacuna.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacuna", description=__doc__)
    p.add_argument("command", choices=["audit", "validate", "list-models", "list-evaluations", "predict", "complete-model", "add-model", "impute"])
    p.add_argument("--scores", required=True, help="CSV or Parquet score table")
    p.add_argument("--model")
    p.add_argument("--evaluation", action="append")
    p.add_argument("--known", help="evaluation=value, ...")
    p.add_argument("--confidence", action="store_true", help="intervals and trust of predict and complete-model, intervals or abstention of add-model")
    p.add_argument("--rank", type=int, default=1)
    p.add_argument("--min-model-scores", type=int, default=3)
    p.add_argument("--min-evaluation-scores", type=int, default=5)
    p.add_argument("--output", help="folder for Parquet instead of JSON lines")
    return p


def run(argv: list[str], spark=None) -> int:
    a = parser().parse_args(argv)
    spark = spark or local_session()
    table = product.open_path(spark, a.scores, rank=a.rank, min_row=a.min_model_scores, min_col=a.min_evaluation_scores)
    try:
        if a.command in ("predict", "complete-model") and not a.model or a.command == "add-model" and not a.known:
            raise product.UnknownName(f"{a.command} needs --model or --known")
        frame = {
            "audit": table.audit, "validate": table.validate, "list-models": table.models, "list-evaluations": table.evaluations, "impute": table.impute,
            "predict": lambda: table.predict(a.model, a.evaluation, a.confidence), "complete-model": lambda: table.predict(a.model, confidence=a.confidence), "add-model": lambda: table.add_model(a.known, confidence=a.confidence),
        }[a.command]()
    except product.UnknownName as e:
        print(e, file=sys.stderr)
        return 2
    if a.output:
        frame.write.mode("overwrite").parquet(a.output)
    else:
        for row in frame.toLocalIterator():
            print(json.dumps(row.asDict(), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
