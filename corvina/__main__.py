"""spark-submit entry: ``python -m corvina <command> ...``. Exit codes: 0 done, 2 wrong call, 3 nothing to work on."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as contract
from .operators import dedup, export, harvest, reports
from .operators.search import SearchQuery
from .schema import append
from .sources import connectors, corpus_file, exports

REPORTS = {
    "quality": reports.quality_rounded, "integrity": reports.integrity_counts, "references": reports.reference_coverage, "profile": reports.corpus_profile,
    "checksum": lambda r: harvest.corpus_checksum(harvest.fingerprints(r)), "digest": lambda r: harvest.corpus_digest(harvest.fingerprints(r)),
}
TABLES = {"csv": export.csv_frame, "screening": export.screening_frame, "scopus": export.scopus_frame}
TEXTS = {"ris": lambda r: r.select("ord", export.ris_text().alias("text")), "bibtex": export.bibtex_frame}


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """Records of a Parquet table, or of a corpus document (.json)."""
    return corpus_file.read(spark, path)[0] if path.endswith(".json") else spark.read.parquet(path)


def exported(records: DataFrame, kind: str, out: str) -> None:
    if kind in TEXTS:
        export.write_text(TEXTS[kind](records), out)
    else:
        export.write_csv(TABLES[kind](records), out)


def query_of(config: dict) -> SearchQuery:
    given = dict(config)
    return SearchQuery(**given | ({"years": tuple(given["years"])} if given.get("years") else {}))


def read_config(path: str) -> dict | None:
    try:
        config = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    except (OSError, ValueError) as e:
        print(f"{path}: {e}", file=sys.stderr)
        return None
    found = contract.faults(config)
    for fault in found:
        print(fault, file=sys.stderr)
    return None if found else config


def run(spark: SparkSession, config: dict, out: str) -> int:
    """Files to records, duplicates out, reports and exports: what a configuration without network sources asks for."""
    records = searches = None
    rows = []
    for n, f in enumerate(config.get("files", []), 1):
        found = exports.read_exports(spark, f["path"], f.get("format", "auto"), f.get("dialect", "auto"), f.get("source", ""), f.get("encoding", "auto"))
        own = exports.records_of(found)
        event = {"search_id": f"S{n}", "database": f.get("source", "") or "import"}
        first = records.count() if records is not None else 0
        own = append(own.limit(0), own, event, first)
        rows.append((n - 1, event["search_id"], event["database"], f["path"], own.count()))
        records = own if records is None else records.unionByName(own)
    if records is None or records.isEmpty():
        return 3
    searches = spark.createDataFrame(rows, "ord long, search_id string, database string, notes string, records_retrieved long")
    records.write.mode("overwrite").parquet(f"{out}/records")
    records = spark.read.parquet(f"{out}/records")
    result = dedup.deduplicate(records, **config.get("dedup", {}))
    result.records.write.mode("overwrite").parquet(f"{out}/unique")
    export.write_decisions(result.decisions, f"{out}/decisions")
    unique = spark.read.parquet(f"{out}/unique")
    counts = {r["name"]: r["n"] for r in result.counts.collect()}
    for kind in config.get("exports", []):
        exported(unique, kind, f"{out}/{kind}")
    flow = reports.flow(spark, identified=counts["before"], duplicates_removed=counts["before"] - counts["after"], **config.get("flow", {}))
    summary = {"config_checksum": contract.checksum(config), "counts": counts, "digest": harvest.corpus_digest(harvest.fingerprints(unique)).first()["digest"]}
    parts = ["# Run", "", "```", json.dumps(summary, indent=1, sort_keys=True), "```", "", "## Flow", "", reports.markdown(flow.drop("problems")), "", "## Sources", "", reports.markdown(reports.source_audit(searches).drop("names_seen")), "", "## Completeness", "", reports.markdown(reports.quality_rounded(unique))]
    spark.createDataFrame([("\n".join(parts),)], "text string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("corvina")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("parse", help="exports to a table of records")
    c.add_argument("path"), c.add_argument("out"), c.add_argument("--format", default="auto"), c.add_argument("--source", default="")
    c = sub.add_parser("dedup", help="a table of records to one without duplicates")
    c.add_argument("records"), c.add_argument("out"), c.add_argument("--mode", default="sequential"), c.add_argument("--threshold", type=float, default=0.93)
    c = sub.add_parser("report", help="completeness, integrity and references of a table")
    c.add_argument("records"), c.add_argument("kind", choices=tuple(REPORTS))
    c = sub.add_parser("export", help="a table to a file for other programs")
    c.add_argument("records"), c.add_argument("out"), c.add_argument("kind", choices=(*TABLES, *TEXTS, "json"))
    c = sub.add_parser("query", help="a query in each database's syntax")
    c.add_argument("config", help="JSON: blocks, years, doc_types, languages, title_only")
    c = sub.add_parser("check", help="what is wrong with a configuration")
    c.add_argument("config")
    c = sub.add_parser("search", help="a source's pages into an archive (needs a network)")
    c.add_argument("source", choices=tuple(connectors.SOURCES)), c.add_argument("params", help="JSON"), c.add_argument("archive")
    c.add_argument("--most", type=int, default=1000), c.add_argument("--keyvariable", default="")
    c = sub.add_parser("replay", help="what an archive holds, and whether it is whole")
    c.add_argument("archive")
    c = sub.add_parser("flow", help="the counts of a flow diagram")
    c.add_argument("counts", help="JSON"), c.add_argument("--svg", default="")
    c = sub.add_parser("drift", help="what changed between two tables of records")
    c.add_argument("before"), c.add_argument("after")
    c = sub.add_parser("run", help="files to unique records, exports and reports, as a configuration says")
    c.add_argument("config"), c.add_argument("out")
    given = p.parse_args(args)
    if given.command == "query":
        config = json.loads(Path(given.config).read_text())
        found = contract.faults_of(config, contract.QUERY, ("blocks",))
        if found:
            print(f"unknown keys or values: {found}", file=sys.stderr)
            return 2
        print(json.dumps(query_of(config).compile_all(), indent=2, ensure_ascii=False))
        return 0
    if given.command in ("check", "run"):
        config = read_config(given.config)
        if config is None:
            return 2
        if given.command == "check":
            print(contract.checksum(config))
            return 0
    spark = SparkSession.builder.appName("corvina").getOrCreate()
    if given.command == "run":
        return run(spark, config, given.out)
    if given.command == "parse":
        found = exports.read_exports(spark, given.path, given.format, source=given.source).persist()
        print(reports.markdown(exports.accounts(found), 1000))
        exports.records_of(found).write.mode("overwrite").parquet(given.out)
        return 0 if found.where("reason is null").limit(1).count() else 3
    if given.command == "search":
        connectors.register(spark)
        pages = spark.read.format("bibliography").options(source=given.source, params=given.params, maxresults=str(given.most), keyvariable=given.keyvariable).load()
        harvest.write_archive(harvest.archived(pages.persist(), authenticated=bool(given.keyvariable)), given.archive)
        return 0
    if given.command == "replay":
        print(reports.markdown(harvest.verify_archive(harvest.read_archive(spark, given.archive)), 1000))
        return 0
    if given.command == "flow":
        row = reports.flow(spark, **json.loads(given.counts))
        if given.svg:
            Path(given.svg).write_text(reports.flow_svg(row.first()))
        print(reports.markdown(row.withColumn("problems", F.array_join("problems", "; "))))
        return 0
    if given.command == "drift":
        both = [harvest.fingerprints(loaded(spark, x)) for x in (given.before, given.after)]
        print(harvest.drift_markdown(harvest.drift(*both).persist()))
        return 0
    records = loaded(spark, given.records)
    if given.command == "dedup":
        result = dedup.deduplicate(records, mode=given.mode, fuzzy_threshold=given.threshold)
        for name in ("records", "decisions", "overlap", "counts"):
            getattr(result, name).write.mode("overwrite").parquet(f"{given.out}/{name}")
        print(reports.markdown(spark.read.parquet(f"{given.out}/counts")))
    elif given.command == "report":
        print(reports.markdown(REPORTS[given.kind](records)))
    elif given.kind == "json":
        corpus_file.write(records, spark.createDataFrame([], "ord long, search_id string"), given.out)
    else:
        exported(records, given.kind, given.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
