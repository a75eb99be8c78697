"""Integrity of results, as tables of violations and as checks that raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.blocking import union_sources
from weftline.sources import tsv

#: Kinds of violations in the order in which they are reported.
CHECKS = ("coverage", "missing", "extra", "duplicate", "self", "invalid", "not_candidate")
# The messages.
MESSAGES = {
    "coverage": "Coverage mismatch: {}",
    "missing": "Missing Source 1 entities in matching results: {}",
    "extra": "Unexpected extra entities in matching results: {}",
    "duplicate": "Duplicate match IDs found for entity {}",
    "self": "Self-match detected: {}",
    "invalid": "Invalid candidate IDs for entity {}",
    "not_candidate": "Candidate constraint violation for {}",
}


def violations(s1: DataFrame, s2: DataFrame, s3: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(check, source1_entity_id, ids): all violations.

    ``candidates`` and ``matches`` have (source1_entity_id, ids). All checks are joins and aggregates.
    """
    key = lambda df: df.select(T.strip(F.col("entity_id")).alias("source1_entity_id"))
    s1_ids, own = key(s1), matches.select("source1_entity_id")
    out = []

    def report(check: str, rows: DataFrame, ids: str | None = None) -> None:
        out.append(rows.select(F.lit(check).alias("check"), "source1_entity_id", (F.col(ids) if ids else F.lit(None).cast("string")).alias("ids")))

    twice = own.groupBy("source1_entity_id").count().filter("count > 1")
    report("coverage", twice)
    report("missing", s1_ids.join(own, "source1_entity_id", "left_anti"))
    report("extra", own.join(s1_ids, "source1_entity_id", "left_anti"))
    known = matches.join(s1_ids.distinct(), "source1_entity_id", "left_semi")
    joined = F.array_join(F.array_sort("ids"), ",").alias("list")
    report("duplicate", known.filter(F.size("ids") != F.size(F.array_distinct("ids"))).select("source1_entity_id", joined), "list")
    report("self", known.filter(F.array_contains("ids", F.col("source1_entity_id"))))
    edges = known.select("source1_entity_id", F.explode(F.array_distinct("ids")).alias("id"))
    gather = lambda df: df.groupBy("source1_entity_id").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("list"))
    targets = union_sources(key(s2), key(s3)).select(F.col("source1_entity_id").alias("id"))
    report("invalid", gather(edges.join(targets, "id", "left_anti")), "list")
    offered = candidates.select("source1_entity_id", F.explode("ids").alias("id"))
    report("not_candidate", gather(edges.join(offered, ["source1_entity_id", "id"], "left_anti")), "list")
    return union_sources(*out)


def first_violation(found: DataFrame, checks=CHECKS) -> tuple[str, str, str] | None:
    """The one that comes first by kind, then by id; one row reaches the driver."""
    rank = F.array_position(F.array(*map(F.lit, checks)), F.col("check"))
    row = found.orderBy(rank, "source1_entity_id").limit(1).collect()
    return tuple(row[0]) if row else None


def validate_inference_outputs(s1: DataFrame, s2: DataFrame, s3: DataFrame, candidates: DataFrame, matches: DataFrame) -> None:
    """Raises ValueError for the first violation."""
    n1, n = s1.count(), matches.count()
    if n1 != n:
        raise ValueError(MESSAGES["coverage"].format(f"expected {n1} entities, found {n}"))
    if hit := first_violation(violations(s1, s2, s3, candidates, matches)):
        check, entity, ids = hit
        raise ValueError(MESSAGES[check].format(entity) + (f": {ids}" if ids else ""))


def validate_submission(spark: SparkSession, matching: str, candidate: str, test_dir: str) -> bool:
    """Checks two written tables against the test tables; raises or returns True."""
    tables = tsv.load_test_data(spark, test_dir)
    s1, s2, s3 = (tables[f"source{k}"] for k in (1, 2, 3))
    lists = {}
    for name, path, columns in (("matches", matching, tsv.TRUTH_COLUMNS), ("candidates", candidate, tsv.CANDIDATE_COLUMNS)):
        df = tsv.read_table(spark, path, columns)
        lists[name] = df.select(T.strip(F.col(columns[0])).alias("source1_entity_id"), tsv.parse_id_list(F.col(columns[1])).alias("ids"))
    n1 = s1.count()
    for name, df in lists.items():
        if (n := df.count()) != n1:
            raise ValueError(f"Row count mismatch in {name}: expected {n1}, found {n}")
    # Candidates keep the rules of matches but the last, and are compared with themselves there.
    for name in ("matches", "candidates"):
        if hit := first_violation(violations(s1, s2, s3, lists["candidates"], lists[name])):
            check, entity, ids = hit
            raise ValueError(f"{name}: " + MESSAGES[check].format(entity) + (f": {ids}" if ids else ""))
    return True


def main(argv: list[str] | None = None) -> int:
    """Command line: matching, candidates, test folder. 0 and PASS, or 1 and FAIL."""
    import sys

    from weftline.session import get_session

    args = sys.argv[1:] if argv is None else argv
    try:
        validate_submission(get_session(), *args)
    except (ValueError, FileNotFoundError) as e:
        print(f"FAIL: {e}")
        return 1
    print("PASS")
    return 0
