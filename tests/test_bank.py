"""Question-bank operators on small rows."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import bank_merge, library, profile, scoring, sequence, storage, support
from paperloom.sources import backup


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column("x")).first()[0]


@pytest.mark.parametrize("value,want", [(None, ""), ("第１２题", "12"), ("0", ""), ("007", "7"), ("12345", "123"), ("x", ""), ("000 5", "")])
def test_question_number(spark, value, want):
    assert one(spark, T.question_number, value) == want


@pytest.mark.parametrize("value,want", [("（Ａ）. \\left b，　C", "(a)bc"), (None, ""), ("x﻿Y", "xy")])
def test_compare_text(spark, value, want):
    assert one(spark, T.compare_text, value) == want


def test_has_text_knows_wide_blanks(spark):
    assert [one(spark, T.has_text, v) for v in ("　﻿ \n", None, "", "　a")] == [False, False, False, True]


@pytest.mark.parametrize("value,valid,pages", [("", True, [1, 2, 3, 4, 5]), ("2-3,1", True, [1, 2, 3]), ("4-9", True, [4, 5]), ("3-2", False, []), ("0", False, []), ("1，2", False, []), ("a", False, [])])
def test_page_ranges(spark, value, valid, pages):
    assert one(spark, T.valid_page_range, value) is valid
    assert one(spark, lambda c: T.expand_page_range(c, F.lit(5)), value) == pages


def test_boxes(spark):
    assert one(spark, T.normal_box, [5.0, 6.0, 1.0, 2.0], "array<double>") == [1, 2, 5, 6]
    assert one(spark, T.normal_box, [1.0, 1.0, 1.0, 2.0], "array<double>") == []
    assert one(spark, T.normal_box, [1.0, None, 1.0, 2.0], "array<double>") == []


def lists(spark, **names):
    kinds = ", ".join(f"{n} array<int>" for n in names)
    return spark.createDataFrame([("d", *names.values())], f"doc_id string, {kinds}")


def rows(spark, numbers):
    return spark.createDataFrame([("d", i, n) for i, n in enumerate(numbers)], "doc_id string, ordinal int, number int")


@pytest.mark.parametrize(
    "a,s,e,mode,safe,fused",
    [
        ([1, 2, 3], [1, 2, 3], [1, 2, 3], "full", [1, 2, 3], []),
        ([1, 2, 2, 3], [1, 2, 2, 3], [1, 2, 3, 4], "prefix", [1, 2], [3, 4]),
        ([1, 3, 4, 5, 2], [1, 3, 4, 5, 2], [1, 2, 3, 4, 5], "prefix", [1], [2, 3, 4, 5]),
        ([1, 2, 3], [1, 3], None, "prefix", [1], [2, 3]),
        ([2, 3], [3, 2], None, "fail-closed", [], [2, 3]),
        ([4, 5], [4, 5], None, "full", [4, 5], []),
        ([1, None], [1, 2], None, "prefix", [1], [2]),
        ([], [1], [1, 2], "fail-closed", [], [1, 2]),
    ],
)
def test_align(spark, a, s, e, mode, safe, fused):
    got = sequence.align(rows(spark, a), rows(spark, s), rows(spark, e) if e else None).first()
    assert (got["mode"], got["safe_numbers"], got["fused_numbers"]) == (mode, safe, fused)
    assert (mode == "full") == (not got["reasons"])


def test_sequence_report(spark):
    got = sequence.sequence_report(lists(spark, a=[1, 2, 2, 5, 0], e=[1, 2, 3]), "a", "e").first()
    assert (got["n"], got["n_invalid"], got["duplicates"], got["increasing"], got["gaps"], got["jump_backs"]) == (5, 1, [2], False, 1, 1)
    assert (got["missing"], got["unexpected"], got["set_equal"]) == ([3], [0, 5], False)


def test_attach_by_number_by_place_and_never_by_guess(spark):
    schema = "doc_id string, ordinal int, question string, answer string"
    drafts = spark.createDataFrame([("a", 1, "1", None), ("a", 2, "2", "own"), ("a", 3, "", None), ("b", 1, "1", None), ("b", 2, "2", None)], schema)
    items = spark.createDataFrame([("a", 1, "2.", ""), ("a", 2, "2", "late"), ("a", 3, "9", "x"), ("b", 1, None, "A"), ("b", 2, "", "B")], schema)
    filled, unused = support.attach_items(drafts, items)
    assert {(r["doc_id"], r["ordinal"]): (r["answer"], r["matched"]) for r in filled.collect()} == {
        ("a", 1): (None, False), ("a", 2): ("own", True), ("a", 3): (None, False), ("b", 1): ("A", True), ("b", 2): ("B", True)
    }
    assert sorted(r["ordinal"] for r in unused.collect()) == [2, 3]


def test_fill_only_never_overwrites(spark):
    schema = "doc_id string, ordinal int, question string, answer string"
    there = spark.createDataFrame([("a", 1, "1", "x"), ("a", 2, "2", " ")], schema)
    new = spark.createDataFrame([("a", 1, "1", "y"), ("a", 2, "2", "z"), ("a", 3, "2", "w"), ("a", 4, "3", ""), ("a", 5, "8", "v")], schema)
    got = {r["ordinal"]: r["outcome"] for r in support.fill_only(there, new, new.where("ordinal < 5")).collect()}
    assert got == {1: "skippedExisting", 2: "added", 3: "skippedExisting", 4: "skippedEmpty", 5: "skippedUnknown"}


BANK = "id long, stem string, options array<string>, answer string, solution string, knowledge string"


def test_merge_plan_apply_revert(spark):
    own = spark.createDataFrame([(1, "S one", ["a"], "A", "", ""), (2, "two", [], "B", "s", "k"), (3, "", [], "", "", "")], BANK)
    new = spark.createDataFrame([(11, "s ONE.", ["A"], "A", "why", ""), (12, "two", [], "C", "", ""), (13, "two", ["x"], "", "", ""), (14, "four", [], "D", "", ""), (15, "two", [], "b", "", ""), (16, "", [], "E", "", "")], BANK)
    plan = bank_merge.merge_plan(new, own)
    assert {r["id"]: (r["status"], r["own_id"], r["action"]) for r in plan.collect()} == {
        11: ("fillable", 1, "fill"), 12: ("answerConflict", 2, "skip"), 13: ("similar", 2, "skip"), 14: ("new", None, "add"), 15: ("existing", 2, "skip"), 16: ("new", None, "add")
    }
    merged, record = bank_merge.merge_apply(own, new, plan)
    assert {r["id"]: r["solution"] for r in merged.collect()} == {1: "why", 2: "s", 3: "", 14: "", 16: ""}
    assert sorted(map(str, bank_merge.merge_revert(merged, record).collect())) == sorted(map(str, own.collect()))


def test_library(spark):
    q = spark.createDataFrame([(1, 1, "A b"), (2, 2, "ab"), (3, 3, ""), (4, 4, "c"), (5, 5, "A B")], "id long, ordinal long, stem string")
    got = {r["id"]: r["duplicate_of"] for r in library.first_duplicate(q, lambda: T.stem_fingerprint("stem")).collect()}
    assert got == {1: 2, 2: 1, 5: 1}
    last = library.page_of(q, "id", "ordinal", page=99, page_size=2)
    assert [(r["id"], r["page"], r["total_pages"], r["total"]) for r in last.collect()] == [(1, 3, 3, 5)]
    assert library.page_of(q.limit(0), "id", "ordinal").count() == 0
    chosen = library.select_ids(q, q.where("id IN (1, 2)"), toggle=2)
    assert [r["id"] for r in chosen.collect()] == [1] and library.select_ids(q, q, "none").count() == 0


def test_scores(spark):
    schema = "document_id string, page int, source_order int, question_number string, text string, ordinal int"
    truth = spark.createDataFrame([("d", 1, 1, "1", "abc", 1), ("d", 1, 2, "2", "de", 2), ("e", 1, 1, "1", "x", 1)], schema)
    result = spark.createDataFrame([("d", 1, 1, "1", "zzz", 1), ("d", 1, 1, "1", "abd", 2), ("d", 1, 9, "9", "q", 3)], schema)
    got = {r["document_id"]: r for r in scoring.document_scores(scoring.match_rows(truth, result)).collect()}
    assert (got["d"]["n_truth"], got["d"]["n_result"], got["d"]["n_matched"], got["d"]["precision"]) == (2, 2, 1, 0.5)
    assert got["d"]["cer"] == pytest.approx(3 / 6) and got["e"]["cer"] == 1.0
    agg = scoring.corpus_aggregate(spark.createDataFrame([(1.0,), (2.0,), (10.0,), (None,)], "m double"), ["m"]).first()
    assert (agg["n"], agg["median"], agg["p95"]) == (3, 2.0, pytest.approx(9.2))


def test_candidate_gates_and_choice(spark):
    good = dict(engine="e", engine_version="1", schema_valid=True, sequence_valid=True, ownership_valid=True, formula_valid=True, provenance_complete=True, completeness=0.9, confidence=0.8, safety_errors=0)
    cases = [good, good | {"completeness": 0.95}, good | {"confidence": None}, good | {"engine": " "}, good | {"safety_errors": None, "schema_valid": False}]
    requests = ["a", "a", "b", "c", "d"]
    df = spark.createDataFrame([(i, r, *c.values()) for i, (r, c) in enumerate(zip(requests, cases, strict=True))], "id int, request_id string, engine string, engine_version string, schema_valid boolean, sequence_valid boolean, ownership_valid boolean, formula_valid boolean, provenance_complete boolean, completeness double, confidence double, safety_errors int")
    promoted = spark.createDataFrame([("e", "1", True, "h")], "engine string, engine_version string, production_promoted boolean, holdout_decision_id string")
    judged = profile.evaluate_candidates(df, promoted, 0.5)
    assert {r["id"]: r["reasons"] for r in judged.collect()} == {0: [], 1: [], 2: ["engine-confidence-missing"], 3: ["candidate-identity-invalid", "engine-not-production-promoted"], 4: ["schema-invalid", "fatal-safety-errors"]}
    assert {r["request_id"]: (r["decision"], r["selected"]) for r in profile.select_candidates(judged).collect()} == {"a": ("pareto-dominant", 1), "b": ("manual-review", None), "c": ("manual-review", None), "d": ("manual-review", None)}


def test_confirm_order_of_checks(spark):
    drafts = spark.createDataFrame([("a", 1, None), ("b", 2, "k9"), ("c", 1, None)], "id string, version int, submitted_key string")
    stored = spark.createDataFrame([("q9",)], "id string")
    d = lambda i, draft, key="k", actor="x", q="q1", v=1, ok=True: (i, draft, key, actor, "r", q, v, ok)
    cases = [d(1, "a", key=""), d(2, "a", actor=" "), d(3, "z"), d(4, "b", key="k9", q="q9"), d(5, "b", key="other"), d(6, "c", v=7), d(7, "b", key="k9", q="gone")]
    schema = "ordinal int, draft_id string, idempotency_key string, actor_id string, request_id string, question_id string, expected_version int, accepted boolean"
    got = {r["decision_ordinal"]: r["outcome"] for r in storage.confirm_drafts(drafts, spark.createDataFrame(cases, schema), stored).collect()}
    assert got == {1: "idempotency-required", 2: "admission-invalid", 3: "draft-missing", 4: "replay", 5: "draft-already-confirmed", 6: "draft-version-conflict", 7: "corrupt-data"}
    fine = spark.createDataFrame([d(1, "a"), d(2, "c", ok=False)], schema)
    assert {r["draft_id"]: r["outcome"] for r in storage.confirm_drafts(drafts, fine, stored).collect()} == {"a": "committed", "c": "admission-invalid"}


def test_upsert_delete_and_batches(spark):
    stored = spark.createDataFrame([(1, "a", 5, 5, 9, "t"), (2, "b", 5, 6, None, "")], "id long, stem string, created_at long, updated_at long, deleted_at long, confirmation_token string")
    new = spark.createDataFrame([(1, "x", "new", 5, 1), (2, "y", "n", 5, 2), (3, "z", "n", None, 3), (3, "w", "n", None, 4)], "id long, stem string, confirmation_token string, expected_updated_at long, ordinal int")
    out = storage.upsert_outcomes(stored, new, allow_update=True)
    assert {r["ordinal"]: r["outcome"] for r in out.collect()} == {1: "updated", 2: "conflict", 3: "inserted", 4: "duplicate-id"}
    after = {r["id"]: (r["stem"], r["created_at"], r["updated_at"], r["deleted_at"]) for r in storage.upsert_apply(stored, out, 77).collect()}
    assert after == {1: ("x", 5, 77, None), 2: ("b", 5, 6, None), 3: ("z", 77, 77, None)}
    gone = storage.soft_delete(stored, stored, 50)
    assert sorted(r["deleted_at"] for r in gone.collect()) == [9, 50] and storage.restore(gone, stored).where("deleted_at IS NOT NULL").count() == 0


def test_backup_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "id int, stem string")
    backup.write_backup({"questions": q, "unknown": q}, str(tmp_path))
    assert backup.verify_backup(spark, str(tmp_path)).count() == 0
    back = backup.restore_backup(spark, str(tmp_path))
    assert list(back) == ["questions"] and back["questions"].count() == 2
    q.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/questions")
    assert backup.verify_backup(spark, str(tmp_path)).collect() == [("questions", "count-mismatch")]
    with pytest.raises(ValueError):
        backup.restore_backup(spark, str(tmp_path), "other")


def test_entry_has_a_twin_for_every_query_that_names_one():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
