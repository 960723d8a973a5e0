"""Command line for the two user flows.

    python -m tally process <file> <store> [--description TEXT]
    python -m tally ask <store> <dataset_id> "<question>" ["<select ...>"]

Prints JSON.  Uses the active cluster settings when run with spark-submit;
otherwise a local session.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from . import api
from .operators import adhoc
from .session import apply_defaults, local_session


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    return apply_defaults(active) if active is not None else local_session()


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tally")
    sub = p.add_subparsers(dest="cmd", required=True)
    pr = sub.add_parser("process", help="file to ready dataset")
    pr.add_argument("file")
    pr.add_argument("store")
    pr.add_argument("--description", default="")
    ask = sub.add_parser("ask", help="question context and answer")
    ask.add_argument("store")
    ask.add_argument("dataset_id")
    ask.add_argument("question")
    ask.add_argument("sql", nargs="?")
    a = p.parse_args(argv)
    spark = _session()
    if a.cmd == "process":
        rec = api.process_dataset(spark, a.file, a.store, description=a.description)
        print(json.dumps({k: rec[k] for k in ("dataset_id", "status", "summary")}, ensure_ascii=False))
        return
    ctx = api.retrieve_context(spark, a.store, [a.dataset_id], a.question)
    adhoc.attach_datasets(spark, [api.table_paths(spark, a.store, a.dataset_id)])
    answer = adhoc.answer_question(spark, a.question, a.sql, a.dataset_id)
    print(json.dumps({"chunks": ctx["retrieved_chunks"], "answer": answer}, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
