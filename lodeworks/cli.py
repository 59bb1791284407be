"""Command line: checks a rule file, or runs captured pages through the pipeline, against versioned state.

    python -m lodeworks.cli --rules rules.yaml --pages PATH --state PATH --archive PATH [--projects PATH] [--dry-run]
    python -m lodeworks.cli --rules rules.yaml --validate-rules
"""

from __future__ import annotations

import argparse
import datetime
import logging
import os
import sys
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import enrich, rules as R
from .plans import pipeline, publish, report
from .sources import store

LOG = logging.getLogger(__name__)
#: Exit codes.
DONE, BAD_RULES = 0, 2


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="lodeworks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--rules", default="rules.yaml", help="the rule file")
    p.add_argument("--pages", help="captured result pages: Parquet of portal, page_no, url, status, html")
    p.add_argument("--projects", help="captured project lists: Parquet with html")
    p.add_argument("--state", default="state", help="folder of the versioned state")
    p.add_argument("--archive", default="history", help="folder of the monthly archive")
    p.add_argument("--dry-run", action="store_true", help="log what would be reported; write and send nothing")
    p.add_argument("--validate-rules", action="store_true", help="check the rule file and stop")
    p.add_argument("-v", "--verbose", action="store_true")
    return p.parse_args(argv)


def is_on(value: str | None) -> bool:
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def log_dry(done: pipeline.Run) -> None:
    """What a run would report, title by title."""
    for row in report.ranked(done.items).orderBy("rank").select(report.issue_title().alias("title"), "labels").toLocalIterator():
        LOG.info("would report: %s | labels=%s", row["title"], row["labels"])
    for row in done.project_updates.select("name", "status").toLocalIterator():
        LOG.info("would report project: %s (%s)", row["name"], row["status"])
    for row in done.alerts.collect():  # one for each portal at most
        LOG.info("would open an alert for %s (streak %s)", row["portal"], row["zero_streak"])


def run(args: argparse.Namespace, session: Callable[[], SparkSession], to: report.Publisher, env: Mapping[str, str], provider: Callable[[str, str], str] | None = None, today: str | None = None) -> int:
    """One run. provider, if given, fills gaps, but not in a dry run; the state moves on after the reports are sent."""
    try:
        rules = R.load_rules(args.rules, env)
    except R.RulesError as e:
        LOG.error("%s", e)
        return BAD_RULES
    if args.validate_rules:
        LOG.info("%s is valid", args.rules)
        return DONE
    spark = session()
    day = today or datetime.datetime.now(datetime.UTC).date().isoformat()
    dry = args.dry_run or is_on(env.get("DRY_RUN"))
    pages = spark.read.parquet(args.pages)
    projects = spark.read.parquet(args.projects) if args.projects else None
    state = store.load_state(spark, args.state)
    answers: DataFrame | None = None
    if provider is not None and not dry:
        answers = enrich.answers(pipeline.unseen(pages, state), provider)
    done = pipeline.run(pages, projects, state, rules, day, answers)
    for row in done.dropped.orderBy(F.desc("n"), "label").collect():  # one for each rule
        LOG.info("dropped: %s=%s", row["label"], row["n"])
    if dry:
        log_dry(done)
    else:
        pipeline.publish(done, rules, to, day)
        store.append_archive(done.items, args.archive, day)
        store.save_state(done.state, args.state)
    done.close()
    return DONE


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s", stream=sys.stdout)
    session: object = None
    try:
        import requests

        session = requests.Session()
    except ImportError:
        LOG.info("no HTTP client is installed: nothing is sent")
    to = publish.Services(session, os.environ if session is not None else {})
    return run(args, lambda: SparkSession.builder.appName("lodeworks").getOrCreate(), to, os.environ)


if __name__ == "__main__":
    sys.exit(main())
