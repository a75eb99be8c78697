import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import blocking, decide, features, metrics, models, reports, retrieval, validate
from weftline.plans import linkage
from weftline.sources import tsv
from weftline.streaming import matcher

COLS = "entity_id string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def tables(spark):
    s1 = spark.createDataFrame([("S1-001", "Tata Motors Ltd", "12 Main St, Mumbai 400001", "India"), ("S1-002", "Apple Inc", "1 Infinite Loop, Cupertino 95014", "US"), ("S1-003", "Nobody Knows", "", "")], COLS)
    s2 = spark.createDataFrame([("S2-001", "Tata Motors", "12 Main Street, Mumbai 400001", "India"), ("S2-002", "Apple Computer Inc", "1 Infinite Loop Cupertino", "US")], COLS)
    s3 = spark.createDataFrame([("S3-001", "Tata Motors Commercial", "Mumbai", "india "), ("S3-002", "Renault SA", "Paris", "France")], COLS)
    return s1, s2, s3


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    row = lambda p, i: (f"{p}-{i:03}", " ".join(rng.choices(names, k=rng.randint(1, 3))), " ".join(rng.choices(names, k=2)) + f" {rng.randint(1, 30)}", rng.choice(["US", "India", "us ", ""]))
    return tuple(spark.createDataFrame([row(p, i) for i in range(n)], COLS) for p, n in (("S1", 30), ("S2", 40), ("S3", 20)))


def pairs_of(df):
    return sorted((r[0], r[1]) for r in df.select("source1_entity_id", "candidate_id").collect())


def normalised(tables):
    from weftline.functions.text import normalize_dataframe

    return [normalize_dataframe(t).collect() for t in tables]


def test_blocking_stays_in_country(spark, tables):
    got = pairs_of(blocking.generate_candidates(*tables, top_k=8))
    assert ("S1-001", "S2-001") in got and ("S1-002", "S2-002") in got and ("S1-001", "S3-001") in got
    country = {r["entity_id"]: r["country"].strip().lower() for t in tables for r in t.collect()}
    assert all(country[a] == country[b] for a, b in got)


def test_neighbourhood_against_brute_force(many):
    rows = [(r["country"].strip().lower(), r["business_name_norm"], k, r["entity_id"]) for k, t in enumerate(normalised(many)) for r in t]
    want = set()
    for c in {r[0] for r in rows}:
        group = sorted(r for r in rows if r[0] == c)
        for i, a in enumerate(group):
            for b in group[i + 1 : i + 4]:
                if (a[2] == 0) != (b[2] == 0):
                    want.add((a[3], b[3]) if a[2] == 0 else (b[3], a[3]))
    assert pairs_of(blocking.sorted_neighborhood(*many, window_size=4)) == sorted(want)


def test_tokens_against_brute_force(many):
    from weftline.functions.lexicon import STOP_WORDS

    t1, t2, t3 = normalised(many)
    want = []
    for a in t1:
        for b in t2 + t3:
            ca, cb = a["country"].strip().lower(), b["country"].strip().lower()
            if ca and ca == cb and len(set(a["business_name_norm"].split()) & set(b["business_name_norm"].split()) - set(STOP_WORDS)) >= 2:
                want.append((a["entity_id"], b["entity_id"]))
    assert pairs_of(blocking.token_overlap(many[0], many[1].unionByName(many[2]))) == sorted(want)


def test_tfidf_against_brute_force(many):
    def grams(text):
        out = Counter()
        for w in text.split():
            w = f" {w} "
            out.update(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))
        return out

    t1, t2, t3 = normalised(many)
    text = lambda r: f"{r['business_name_norm']} {r['business_address_norm']}"
    want = []
    for c in {r["country"].strip().lower() for r in t1} - {""}:
        cand = [(r["entity_id"], grams(text(r))) for r in t2 + t3 if r["country"].strip().lower() == c]
        df = Counter(g for _, x in cand for g in x)

        def vec(x, n=len(cand), df=df):
            v = {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[g])) + 1) for g, k in x.items() if g in df}
            norm = math.sqrt(sum(w * w for w in v.values()))
            return {g: w / norm for g, w in v.items()}

        vs = [(i, vec(x)) for i, x in cand]
        for r in t1:
            if r["country"].strip().lower() == c:
                q = vec(grams(text(r)))
                sims = sorted((-round(sum(w * v.get(g, 0) for g, w in q.items()), 9), i) for i, v in vs)
                want += [(r["entity_id"], i) for _, i in sims[:5]]
    got = blocking.tfidf_neighbors(many[0], many[1].unionByName(many[2]), top_k=5)
    assert pairs_of(got) == sorted(want)


@pytest.mark.parametrize("share", [None, 0.3])
def test_tfidf_in_blocks_of_any_size(spark, many, monkeypatch, share):
    rest = many[1].unionByName(many[2])
    found = lambda: sorted((r[0], r[1], round(r[2], 9)) for r in blocking.tfidf_neighbors(many[0], rest, 4, max_gram_share=share).collect())
    whole = found()
    monkeypatch.setattr(blocking, "TEXTS", 5)
    assert found() == whole


def test_nearest_texts_against_brute_force():
    from weftline.functions import grams

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé\U0001f600", k=rng.randint(1, 5)))
    texts, others = ([" ".join(word() for _ in range(rng.randint(0, 4))) for _ in range(n)] for n in (90, 300))

    def vector(text):
        words = [f" {w} " for w in text.split()]
        held = Counter(w[i : i + n] for w in words for n in (2, 3, 4) for i in range(len(w) - n + 1))
        v = {g: (1 + math.log(k)) * idf[g] for g, k in held.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / norm for g, x in v.items()}

    idf = {g: 1 + rng.random() for g in grams.counted(others)[3]}
    vs, want = [vector(t) for t in others], []
    for i, t in enumerate(texts):
        q = vector(t)
        scores = sorted((-round(sum(w * v.get(g, 0) for g, w in q.items()), 9), j) for j, v in enumerate(vs))
        want += [(i, j, -s) for s, j in scores[:6] if s]
    for dense in (grams.DENSE, 7, 0):
        grams.DENSE, before = dense, grams.DENSE
        try:
            got = grams.nearest(texts, others, idf, frozenset(), 6)
        finally:
            grams.DENSE = before
        assert [(int(i), int(j), round(float(s), 9)) for i, j, s in zip(*got, strict=True)] == want


def test_large_groups_meet_as_one_pair_of_classes(spark, monkeypatch):
    from weftline.operators import overlap

    row = lambda p, i: (f"{p}-{i:03}", "same words here" if i < 40 else f"words here {i % 7}", f"{i} road", "US")
    s1, s2 = (spark.createDataFrame([row(p, i) for i in range(n)], COLS) for p, n in (("S1", 50), ("S2", 60)))
    sides = [overlap.side(T.ensure_normalized(t)) for t in (s1, s2)]
    assert overlap.meeting(*sides, 2).count() == 8 * 8
    every = sorted((a["entity_id"], b["entity_id"]) for a in s1.collect() for b in s2.collect())
    assert pairs_of(blocking.token_overlap(s1, s2)) == every
    monkeypatch.setattr(overlap, "CHUNK", 3)
    monkeypatch.setattr(overlap, "PAIRS_PER_TASK", 100)
    assert pairs_of(blocking.token_overlap(s1, s2)) == every
    shared = overlap.overlapping(s1, s2, 3, {"n": F.size(F.array_intersect("a.tokens", "b.tokens"))})
    assert {r["n"] for r in shared.collect()} == {3}


def test_union_of_strategies_does_not_compare_pairs_that_share_tokens(spark, many):
    roaming = [t.unionByName(t.limit(5).withColumn("country", F.lit("Peru"))) for t in many]
    for s1, s2, s3 in (many, roaming):
        rest = s2.unionByName(s3)
        parts = (blocking.tfidf_neighbors(s1, rest, 3), blocking.sorted_neighborhood(s1, s2, s3, 4), blocking.token_overlap(s1, rest))
        got = blocking.generate_candidates(s1, s2, s3, 3, 4)
        assert pairs_of(got) == sorted({p for part in parts for p in pairs_of(part)})
    plain = blocking.generate_candidates(*many, 3, 4)._jdf.queryExecution().optimizedPlan()
    assert plain.nodeName() == "Union"


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(features, "VECTORS", 4)
    v = {i: ([1.0, 0.0] if i % 3 else [math.cos(i), math.sin(i)], i % 2) for i in range(24)}
    df = spark.createDataFrame([(i, label, e) for i, (e, label) in v.items()], "vec_id long, label int, e array<double>")
    got = {(r[0], r[1], r[2] + 0.0) for r in features.nearest_vectors(df, 3).collect()}
    want = set()
    for i, (e, label) in v.items():
        scores = sorted((-round(e[0] * f[0] + e[1] * f[1], 6), j) for j, (f, other) in v.items() if j != i and other == label)
        want |= {(i, j, -s + 0.0) for s, j in scores[:3]}
    assert got == want


def test_padding_fills_up(spark, tables):
    s1, s2, s3 = tables
    got = blocking.tfidf_neighbors(s1, s2.unionByName(s3), top_k=8)
    assert Counter(a for a, _ in pairs_of(got)) == {"S1-001": 2, "S1-002": 1}


def test_blocking_metrics(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "source1_entity_id string, candidate_id string")
    truth = spark.createDataFrame([("a", ["x"]), ("b", ["z", "w"])], "source1_entity_id string, matched_entity_ids array<string>")
    r = blocking.evaluate_blocking(pairs, truth, 2, 3, 1).first()
    assert round(r["recall"], 4) == 66.6667 and r["captured_matches"] == 2 and r["total_candidates"] == 3 and r["reduction_ratio"] == 1 - 3 / 8
    assert blocking.evaluate_blocking(pairs, truth.limit(0), 2, 0, 0).first()["recall"] == 100.0


def test_features_and_labels(spark, tables):
    s1, s2, s3 = tables
    pairs = blocking.generate_candidates(s1, s2, s3)
    matrix = features.build_feature_matrix(pairs, s1, s2, s3.limit(0))
    assert matrix.columns == ["source1_entity_id", "candidate_id", *features.FEATURES]
    row = matrix.filter("candidate_id = 'S2-001'").first()
    assert row["name_token_set_ratio"] == 100.0 and row["name_first_word_match"] == 1 and row["name_num_common_tokens"] == 2
    assert row["pincode_match"] == 1 and row["same_country"] == 1 and row["has_landmark_both"] == 0 and row["combined_similarity"] > 80
    truth = spark.createDataFrame([(" S1-001", ["S2-001 ", "S3-001"])], "source1_entity_id string, matched_entity_ids array<string>")
    labeled = features.assign_labels(pairs, truth)
    assert labeled.filter("label = 1").count() == 2
    balance = features.class_balance(labeled).first()
    assert balance["positives"] == 2 and balance["total"] == labeled.count()


def scored_table(spark, n=60):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        for j in range(4):
            y = int(j == 0 and i % 3 > 0)
            rows.append((f"S1-{i}", f"S2-{i}-{j}", y, 0.7 * y + 0.3 * rng.random(), rng.random()))
    return spark.createDataFrame(rows, "source1_entity_id string, candidate_id string, label int, x double, z double")


def test_split_has_no_leakage_and_keeps_strata(spark):
    labeled = features.split_by_entity(scored_table(spark), 0.2)
    features.check_no_leakage(labeled)
    by = {(r[0], r[1]): r[2] for r in labeled.groupBy("split", "label").agg(F.count_distinct("source1_entity_id")).collect()}
    assert by["val", 1] == 8 and by["train", 1] == 32 and by["val", 0] == 12
    with pytest.raises(ValueError, match="leakage"):
        features.check_no_leakage(labeled.unionByName(labeled.withColumn("split", F.when(F.col("split") == "val", "train").otherwise("val"))))


def test_models(spark, tmp_path):
    labeled = features.split_by_entity(scored_table(spark))
    out = linkage.train(labeled.persist(), n_splits=3, rounds=5)
    assert set(out["metrics"]) == {"boosted_trees", "logistic"} and out["chosen"] in out["metrics"]
    for m in out["metrics"].values():
        assert all(0 <= m[k] <= 1 for k in ("roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1")) and m["roc_auc"] > 0.95
    ensemble, held, summary = models.train_cv_ensemble(labeled.drop("split"), 3, rounds=3)
    assert held.count() == labeled.count() and 0.9 < summary["oof_roc_auc"] <= 1
    ensemble.save(str(tmp_path / "m"))
    again = models.Ensemble.load(str(tmp_path / "m"), 3)
    a, b = (sorted(map(tuple, e.score(labeled.drop("split")).select("candidate_id", F.round("match_probability", 6)).collect())) for e in (ensemble, again))
    assert a == b
    assert [c for c, _ in models.top_importances(ensemble.importances(["x", "z"]), 1)] == ["x"]
    truth = labeled.filter("label = 1").groupBy("source1_entity_id").agg(F.collect_list("candidate_id").alias("matched_entity_ids"))
    curve, t = linkage.tune_threshold(out["model"], labeled.filter("split = 'val'").drop("split"), truth, labeled.filter("split = 'val'"))
    assert curve.count() == 27 and 0.3 <= t <= 0.95


def test_entity_f05(spark):
    lists = "source1_entity_id string, {} array<string>"
    cases = [([], [], 1.0), (["x"], [], 0.0), ([], ["x"], 0.0), (["A"], ["A", "B"], 5 / 6), (["A", "B"], ["A"], 5 / 9), ([" A", "A", ""], ["A"], 1.0), (None, ["A"], 0.0)]
    pred = spark.createDataFrame([(str(i), p) for i, (p, _, _) in enumerate(cases)], lists.format("ids"))
    truth = spark.createDataFrame([(str(i), t) for i, (_, t, _) in enumerate(cases)], lists.format("matched_entity_ids"))
    got = {r["source1_entity_id"]: r["f0_5"] for r in metrics.entity_metrics(pred, truth).collect()}
    assert all(abs(got[str(i)] - w) < 1e-12 for i, (_, _, w) in enumerate(cases))
    assert metrics.macro_metrics(pred, truth.limit(0)).first()["f0_5"] == 0.0


@pytest.mark.parametrize(
    "best,want",
    [((0.65, 0.675, 0.7), 0.675), ((0.4, 0.5), 0.5), ((0.6, 0.65, 0.7, 0.75, 0.8), 0.7), ((0.9,), 0.9)],
)
def test_best_threshold(spark, best, want):
    rows = [(t, 0.5 + t / 10, 0.5, 0.9 if t in best else 0.5) for t in metrics.THRESHOLDS]
    curve = spark.createDataFrame(rows, "threshold double, precision double, recall double, f0_5 double")
    assert metrics.best_threshold(curve).first()["threshold"] == want


def test_binary_metrics_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (0, 0.1)]
    r = metrics.binary_metrics(spark.createDataFrame(rows, "label int, score double")).first()
    assert r["roc_auc"] == round((1 * 2.5 + 1 * 2) / 6, 5) and r["pr_auc"] == round(0.5 * 0.5 + 0.5 * 2 / 3, 5)
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (2, 1, 0, 2)
    one = metrics.binary_metrics(spark.createDataFrame([(1, 0.9)], "label int, score double")).first()
    assert one["roc_auc"] == 0.0 and one["pr_auc"] == 0.0


def test_margin_and_recovery(spark):
    scored = spark.createDataFrame(
        [("S1-01", "S2-01", 0.9), ("S1-01", "S3-01", 0.5), ("S1-01", "S3-02", 0.3), ("S1-01", "S2-09", 0.61), ("S1-02", "S2-02", 0.8), ("S1-02", "S3-03", 0.5), ("S1-03", "S2-03", 0.2)],
        "source1_entity_id string, candidate_id string, match_probability double",
    )
    norm = "entity_id string, business_name_norm string, business_address_norm string, country string, has_landmark boolean, address_pincode string, business_name string, business_address string"
    row = lambda i, n, a, c: (i, n, a, c, False, "", n, a)
    s1 = spark.createDataFrame([(f"S1-0{k}", "", "", "") for k in (1, 2, 3)], COLS)
    s2 = spark.createDataFrame([row("S2-01", "acme corporation", "12 main street", "US"), row("S2-02", "beta", "x", "US"), row("S2-03", "c", "d", "US"), row("S2-09", "zzz", "q", "US")], norm)
    s3 = spark.createDataFrame([row("S3-01", "acme corp", "12 main street", "us "), row("S3-02", "acme corp", "12 main street", "US"), row("S3-03", "beta", "x", "India")], norm)
    got = {r[0]: r[1] for r in decide.apply_decision(scored, s1, s2, s3).collect()}
    assert got == {"S1-01": ["S2-01", "S3-01"], "S1-02": ["S2-02"], "S1-03": []}
    assert decide.apply_decision(scored, s1, s2, s3, recovery=False).filter("size(ids) = 1").count() == 2


def test_validation(spark, tables):
    s1, s2, s3 = tables
    lists = lambda rows: spark.createDataFrame(rows, "source1_entity_id string, ids array<string>")
    good = [("S1-001", ["S2-001"]), ("S1-002", []), ("S1-003", [])]
    cands = lists([("S1-001", ["S2-001", "S3-001", "S1-001", "S9"]), ("S1-002", []), ("S1-003", [])])
    validate.validate_inference_outputs(s1, s2, s3, cands, lists(good))
    for bad, message in (
        (good[:2], "Coverage mismatch"),
        ([("S1-001", ["S2-001", "S2-001"]), *good[1:]], "Duplicate match IDs"),
        ([("S1-001", ["S1-001"]), *good[1:]], "Self-match detected"),
        ([("S1-001", ["S9"]), *good[1:]], "Invalid candidate IDs"),
        ([("S1-001", ["S2-002"]), *good[1:]], "Candidate constraint violation"),
        ([("S1-009", []), *good[1:]], "Missing Source 1"),
    ):
        with pytest.raises(ValueError, match=message):
            validate.validate_inference_outputs(s1, s2, s3, cands, lists(bad))


def test_lookup_tiers(spark):
    s1 = spark.createDataFrame([("q1", "Tata Motors", "", "IN"), ("q2", "Nissan Cars", "", "IN"), ("q3", "Xyzzy", "77 Lakeview", "IN"), ("q4", "Xyzzy", "Lakeview", "IN"), ("q5", "Nope", "", "IN")], COLS)
    s2 = spark.createDataFrame([(f"t{i}", "Tata Motors", "", "IN") for i in range(3)] + [("n1", "Nissan", "", "in"), ("n2", "Nissan Cars", "", "IN")], COLS)
    s3 = spark.createDataFrame([("a1", "Foo", "77 Lakeview", "IN"), ("a2", "Foo", "78 Lakeview", "IN"), ("x", "Tata Motors", "", "US")], COLS)
    index = retrieval.build_index(s2, s3)
    got = sorted((r[0], r[1], r[2]) for r in retrieval.tiered_lookup(s1, index).collect())
    assert got == [
        ("q1", "t0", 1), ("q1", "t1", 1), ("q1", "t2", 1), ("q2", "n1", 2), ("q2", "n2", 1),
        ("q3", "a1", 3), ("q4", "a1", 3), ("q4", "a2", 3),
    ]
    closed = retrieval.build_index(s2, s3, open_vocabulary=False)
    assert closed.select("entity_id").distinct().collect() == [("x",)]
    assert [r[1] for r in retrieval.query_lookup(s1.filter("entity_id = 'q2'"), index).collect()] == ["n2"]
    plural = spark.createDataFrame([("q", "Motor Tatas", "", "IN")], COLS)
    stemmed = retrieval.build_index(s2, s3, stemming=True)
    assert retrieval.tiered_lookup(plural, index).count() == 0 and retrieval.tiered_lookup(plural, stemmed, stemming=True).count() == 3


def test_reports(spark, tables):
    s1, s2, s3 = tables
    truth = spark.createDataFrame([("S1-001", ["S2-001", "S3-001"]), ("S1-002", ["S2-404"]), ("S1-003", [])], "source1_entity_id string, matched_entity_ids array<string>")
    assert {r[0]: r[1] for r in reports.match_histogram(truth).collect()} == {"0 matches": 1, "1 match": 1, ">1 matches": 1}
    assert reports.dangling_refs(truth, s2, s3).collect() == [("S1-002", "S2-404")]
    assert {r["country"]: r["total"] for r in reports.country_pivot(s1, s2, s3).collect()} == {"India": 2, "US": 2, "": 1, "india ": 1, "France": 1}
    m = truth.withColumnRenamed("matched_entity_ids", "ids")
    total = reports.inference_summary(s1, m, m).filter("country is null").first()
    assert (total["entities"], total["matched"], total["matches"]) == (3, 2, 3)
    assert reports.matched_pairs(truth, s1, s2, s3).count() == 2
    assert reports.prefix_compliance({"S1-": s1, "S2-": s3}).filter("without > 0").collect() == [("S2-", 2, 2)]


def write_tsv(path, header, rows):
    path.write_text("\n".join(["\t".join(header), *("\t".join(r) for r in rows)]) + "\n")


def test_files_end_to_end(spark, tables, tmp_path):
    for k, t in enumerate(tables, 1):
        write_tsv(tmp_path / f"test_source{k}.tsv", tsv.ENTITY_COLUMNS, [tuple(r) for r in t.collect()])
    read = tsv.load_test_data(spark, str(tmp_path))
    assert read["source1"].filter("entity_id = 'S1-003'").first()["business_address"] == ""
    with pytest.raises(FileNotFoundError):
        tsv.read_table(spark, str(tmp_path / "none.tsv"))
    write_tsv(tmp_path / "bad.tsv", ("entity_id", "name"), [])
    with pytest.raises(ValueError, match="Invalid columns in"):
        tsv.read_table(spark, str(tmp_path / "bad.tsv"))
    out = linkage.run_rule_matching(spark, str(tmp_path), str(tmp_path / "out"), stemming=True)
    text = next((tmp_path / "out" / "matching_results.tsv").glob("part-*")).read_text()
    assert text.splitlines()[0] == "source1_entity_id\tmatched_entity_ids" and text.splitlines()[1].startswith("S1-001\tS2-001") and text.splitlines()[3] == "S1-003\t"
    assert validate.validate_submission(spark, out["paths"]["matches"], out["paths"]["candidates"], str(tmp_path))
    assert validate.main([out["paths"]["matches"], out["paths"]["candidates"], str(tmp_path / "missing")]) == 1
    tsv.update_threshold(spark, 0.71, str(tmp_path / "params"))
    assert tsv.load_params(spark, str(tmp_path / "params")) == {"match_threshold": 0.71}


def test_stream(spark, tables, tmp_path):
    s1, s2, s3 = tables
    (tmp_path / "in").mkdir()
    for k, r in enumerate(s1.collect()):
        write_tsv(tmp_path / "in" / f"{k}.tsv", tsv.ENTITY_COLUMNS, [tuple(r)])
    q = matcher.match_stream(matcher.read_stream(spark, str(tmp_path / "in")), s2, s3, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert q.exception() is None
    want = pairs_of(retrieval.rule_matches(s1, s2, s3))
    assert pairs_of(spark.read.parquet(str(tmp_path / "out"))) == want and ("S1-001", "S2-001") in want


def test_folds_differ_by_one_entity_of_a_stratum(spark):
    rows = spark.createDataFrame([(f"e{i}", f"c{j}", int(i % 3 == 0 and j == 0)) for i in range(31) for j in range(2)], "source1_entity_id string, candidate_id string, label int")
    dealt = features.fold_of(rows, 4)
    assert dealt.count() == 62
    assert dealt.select("source1_entity_id", "fold").distinct().count() == 31
    sizes = {}
    for i, fold in dealt.select("source1_entity_id", "fold").distinct().collect():
        key = int(i[1:]) % 3 == 0, fold
        sizes[key] = sizes.get(key, 0) + 1
    for stratum in (True, False):
        of = [sizes.get((stratum, f), 0) for f in range(4)]
        assert max(of) - min(of) <= 1
