"""Secret scanning over a trigram inverted index.

Each rule is a regular expression. Its syntax tree gives the strings that every match must contain,
as a Boolean query over trigrams: a disjunction of conjunctions. Postings (trigram, document) are kept
for the trigrams that some query names; intersecting them gives the candidates of each rule, and only
candidates are verified with the expression itself. A rule from which no mandatory trigram follows is
verified on every text.

Everything runs as DataFrame expressions. Offsets, which SQL regular expressions do not return, follow
from the lengths of the pieces between matches.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, sketch_of, within

#: An exact set larger than this is closed into a query.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Rules that this module adds to the base.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def _plain(pattern: str) -> str:
    """The pattern for Python's parser, in lower case: trigrams are looked up in lowered text."""
    return pattern.replace("(?i)", "")


Query = frozenset  # of frozensets of trigrams: any of the sets, all of its trigrams


def _closed(strings: set[str]) -> Query | None:
    """The query that one of the strings occurs; None if that says nothing."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    joined = frozenset(x | y for x, y in product(a, b))
    return joined if len(joined) <= MAX_STRINGS else min(a, b, key=len)


def _walk(items) -> tuple[set[str] | None, Query | None]:
    """What a sequence must match: its exact strings if they are few, and a query."""
    run, query, exact = {""}, None, True

    def end() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _closed(run)), {""}, False

    for op, value in items:
        one: set[str] | None = None
        inner: Query | None = None
        if op is sre.LITERAL:
            one = {chr(value).lower()}
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in value:
                if kind is sre.LITERAL and chars is not None:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and chars is not None and x[1] - x[0] < 8:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
            one = chars
        elif op is sre.SUBPATTERN:
            one, inner = _walk(value[3])
        elif op is sre.BRANCH:
            found = [_walk(x) for x in value[1]]
            if all(x is not None for x, _ in found):
                one = set().union(*(x for x, _ in found))
            else:
                closed = [_both(q, _closed(x) if x is not None else None) for x, q in found]
                inner = None if any(q is None for q in closed) else frozenset().union(*closed)
        elif op is sre.MAX_REPEAT:
            low, high, body = value
            part, part_query = _walk(body)
            if part is not None and low == 0 and high == 1:
                one = part | {""}
            elif low >= 1:
                inner = _both(part_query, _closed({s * min(low, 8) for s in part}) if part is not None and len(part) == 1 else None)
        if one is not None and len(run) * len(one) <= MAX_STRINGS:
            run = {a + b for a in run for b in one}
        else:
            end()
            query = _both(query, inner if one is None else _closed(one))
    if exact:
        return run, None
    end()
    return None, query


def trigram_query(pattern: str) -> Query | None:
    """Disjunction of trigram sets, one of which every match of the pattern contains in lower case.

    None if the pattern has no mandatory trigram.
    """
    exact, query = _walk(sre_parse.parse(_plain(pattern)))
    query = _closed(exact) if exact is not None else query
    # A clause that contains another says no more than the other.
    return query and frozenset(x for x in query if not any(y < x for y in query))


def _candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): the names of the rules whose query a document's postings satisfy."""
    spark = docs.sparkSession
    clauses = [
        (t, rule.kind, k, len(grams)) for rule in rules for k, grams in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or ()))) for t in grams
    ]
    named = sorted({t for t, *_ in clauses})
    if not named:
        return docs.select("doc_id").distinct().withColumn("rules", F.array().cast("array<string>"))
    table = spark.createDataFrame(clauses, "trigram string, kind string, clause int, n int")
    lowered = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in named)))
    postings = lowered.select("doc_id", F.explode(held).alias("trigram"))
    # The clause table is fixed by the rules, not by the data.
    met = (
        postings.join(F.broadcast(table), "trigram")
        .groupBy("doc_id", "kind", "clause", "n")
        .agg(F.size(F.collect_set("trigram")).alias("held"))
        .filter("held = n")
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("rules"))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost, non-overlapping matches as structs (start, order, end, kind); offsets in code points."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    items = F.zip_with(found, groups, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
    items = F.zip_with(items, F.slice(between, 1, F.size(found)), lambda x, p: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.length(p).alias("p")))
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["m"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["g"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    listed = F.aggregate(items, start, step)["out"]
    return F.when(F.size(found) > 0, listed).otherwise(F.array().cast(kind))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is an empty one and holds nothing. Rows that repeat an id share their candidate rules
    and are verified each on its own text. An empty table gives an empty result.
    """
    rules = BASE_RULES + more
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = checkpointed(_candidates(rows, rules).withColumnRenamed("doc_id", "hit"))
    # Texts that no rule's postings name are not shuffled.
    named = within(F.xxhash64("doc_id"), sketch_of(hits, F.xxhash64("hit")))
    joined = rows.filter(named).join(hits, F.col("doc_id").eqNullSafe(F.col("hit")), "left").drop("hit")
    joined = joined.unionByName(rows.filter(~named).withColumn("rules", F.lit(None).cast("array<string>")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    found = []
    for k, rule in enumerate(rules):
        listed = spans(F.col("text"), rule, k)
        if trigram_query(rule.pattern) is not None:
            listed = F.when(F.array_contains("rules", rule.kind), listed).otherwise(none)
        else:
            listed = F.when(F.col("text").rlike(rule.pattern), listed).otherwise(none)
        found.append(listed.alias(rule.kind))
    each = joined.select("doc_id", *found)
    base = [r.kind for r in BASE_RULES]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    in_order = F.array_sort(F.concat(*base))
    everything = F.array_sort(F.concat(*(r.kind for r in rules)))
    return each.select("doc_id", *counts, F.sha2(_joined(in_order), 256).alias("base_sha256"), _joined(everything).alias("spans"))


def oracle_sql(more: tuple[Rule, ...] = MORE_RULES) -> str:
    rules = BASE_RULES + more

    def of(k: int, rule: Rule) -> str:
        quoted = rule.pattern.replace("'", "''")
        m, g = (f"regexp_extract_all(t, '{quoted}', {n})" for n in (0, rule.group))
        p = f"regexp_split_to_array(t, '{quoted}')"
        start = "(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))"
        return (
            f"(SELECT coalesce(list({{'start': {start}::INT, 'order': {k}, 'end': ({start} + length(m[i]))::INT, 'kind': '{rule.kind}'}}), []) "
            f"FROM (SELECT {m} AS m, {g} AS g, {p} AS p) q, unnest(range(1, len(m) + 1)) u(i) WHERE length(g[i]) >= {rule.least}) AS k_{rule.kind}"
        )

    listed = ", ".join(of(k, r) for k, r in enumerate(rules))
    joined = "array_to_string(list_transform(list_sort({}), lambda s: s.kind || ':' || s.start || ':' || s.\"end\"), ',')"
    base = "k_assign || k_access || k_hex"
    everything = " || ".join(f"k_{r.kind}" for r in rules)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (SELECT doc_id, {listed} FROM d) "
        f"SELECT doc_id, len(k_assign)::BIGINT AS n_assign, len(k_access)::BIGINT AS n_access, len(k_hex)::BIGINT AS n_hex, "
        f"sha256({joined.format(base)}) AS base_sha256, {joined.format(everything)} AS spans FROM e"
    )
