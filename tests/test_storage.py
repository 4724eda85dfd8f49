"""Commits of several tables, question rules, bulk confirmation, and backups with blobs."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import confirmation, question_schema
from paperloom.sources import backup, commits

T = "2026-07-13T01:00:00.000Z"


def test_commits(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    ids = lambda name: sorted(r["id"] for r in commits.read_set(spark, root)[name].collect())
    assert commits.current(spark, root) == (0, {}) and commits.read_set(spark, root) == {}
    assert commits.commit(spark, root, {"a": rows(1), "b": rows(2)}, expected=0) == 1
    old = commits.read_set(spark, root)["a"]
    assert commits.commit(spark, root, {"a": commits.read_set(spark, root)["a"].unionAll(rows(3))}, expected=1) == 2
    assert ids("a") == [1, 3] and ids("b") == [2] and old.count() == 1
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, root, {"a": rows()}, expected=1)
    with pytest.raises(Exception):
        commits.commit(spark, root, {"b": rows(9), "c": rows(5).select(F.raise_error(F.lit("broken")).alias("x"))})
    assert ids("a") == [1, 3] and ids("b") == [2]
    (tmp_path / "commits" / "000000000003").write_text('{"tabl')  # a writer that died
    assert ids("a") == [1, 3] and commits.commit(spark, root, {"a": rows(4)}, drop_others=True) == 4
    assert ids("a") == [4] and set(commits.read_set(spark, root)) == {"a"}


def test_iso_times(spark):
    good = [T, "2024-02-29T23:59:59.999Z", "0000-01-01T00:00:00.000Z"]
    bad = ["2026-07-13T01:00:00Z", "2026-02-30T00:00:00.000Z", "2025-02-29T00:00:00.000Z", "2026-07-13T24:00:00.000Z", "2026-13-01T00:00:00.000Z", "x", "", None, "2026-07-13T01:00:00.000+00:00"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i int, t string").select("i", question_schema.iso_time(F.col("t")).alias("y"))
    assert [r["y"] for r in sorted(got.collect())] == [True] * 3 + [False] * len(bad)


DRAFTS = "id string, batch_id string, version int, status string, type string, source_mode string, source_id string, question_number string, stem string, options array<string>, answer string, solution string, images array<string>, provenance array<struct<field:string,status:string,manual_edit_revision:int,source_id:string,evidence_ref:string,controlled_write_accepted:boolean,controlled_write_decision_id:string>>, submitted_question_id string, submitted_key string, admission_decision_id string, updated_at long"
REQUESTS = "ordinal int, draft_id string, idempotency_key string, actor_id string, request_id string, question_id string, expected_version int, explicit_confirmation boolean, package_schema_valid boolean, mode string"


def draft(i, good=True, batch="b1", status="new", version=1, sid=None, key=None):
    fields = [("question_number", "manual"), ("stem", "manual" if good else "rejected"), ("options", "missing"), ("answer", "missing"), ("solution", "manual"), ("images", "missing")]
    return (i, batch, version, status, "解答题", "manual", "s1", "1", f"stem {i}", [], "", "sol", [], [(f, s, 1 if s == "manual" else None, None, None, None, None) for f, s in fields], sid, key, None, 1)


def empty_set(spark, drafts, questions=None):
    state = {"draftQuestions": spark.createDataFrame(drafts, DRAFTS)}
    shaped = question_schema.question_rows(state["draftQuestions"].limit(0).select("*", *[F.lit("").alias(c) for c in ("question_id", "decision_id", "mode", "actor_id", "idempotency_key")]), T)
    state["questions"] = shaped if questions is None else shaped.unionByName(spark.createDataFrame([(q,) for q in questions], "id string"), True)
    state["images"] = spark.createDataFrame([("i0", "old")], "id string, src string")
    state["draftImportBatches"] = spark.createDataFrame([("b1", 0, 1, None), ("b2", 0, 1, None)], "id string, submitted_count long, updated_at long, last_admission_decision_id string")
    return state


def decisions_of(spark, drafts):
    from paperloom.operators.admission import evaluate_admission

    contexts = spark.createDataFrame([(d[0], "manual", "a", "r", "k", True, None) for d in drafts], "draft_id string, mode string, actor_id string, request_id string, idempotency_key string, explicit_confirmation boolean, package_schema_valid boolean")
    return evaluate_admission(spark.createDataFrame(drafts, DRAFTS), contexts)


def slow_outcomes(drafts, stored, requests):
    """The requests one after another."""
    state = {d[0]: {"sent": d[3] == "submitted", "key": d[15], "question": d[14], "version": d[2], "good": d[13][1][1] == "manual"} for d in drafts}
    there, found = set(stored), []
    for ordinal, draft_id, key, actor, request, question, version, explicit, _, _ in sorted(requests):
        d = state.get(draft_id)
        if not (key or "").strip():
            out = "idempotency-required"
        elif not actor or not request:
            out = "admission-invalid"
        elif version is None:
            out = "draft-version-conflict"
        elif d is None:
            out = "draft-missing"
        elif d["sent"]:
            out = "draft-already-confirmed" if d["key"] != key else "replay" if d["question"] in there else "corrupt-data"
        elif d["version"] != version:
            out = "draft-version-conflict"
        elif not d["good"] or not explicit:
            out = "admission-invalid"
        elif not question:
            out = "missing-id"
        elif question in there:
            out = "duplicate-id"
        else:
            out = "committed"
            d.update(sent=True, key=key, question=question, version=version + 1)
            there.add(question)
        found.append((ordinal, out))
    return found


def test_outcomes_against_one_after_another(spark):
    rng = random.Random(11)
    drafts = [draft(f"d{i}", good=i % 5 != 4, version=1 + i % 2) for i in range(30)] + [draft("s1", status="submitted", sid="q0", key="k1"), draft("s2", status="submitted", sid="gone", key="k1")]
    requests = []
    for n in range(260):
        d = rng.choice([f"d{rng.randrange(30)}", f"d{rng.randrange(30)}", "s1", "s2", "none"])
        version = 1 + (int(d[1:]) % 2 if d[0] == "d" else 0)
        key = rng.choice(["k1", "k1", "k2", "", None])
        requests.append((n, d, key, rng.choice(["a"] * 9 + [""]), "r", rng.choice([f"q{rng.randrange(25)}", f"q{rng.randrange(25)}", f"q{rng.randrange(25)}", ""]), rng.choice([version] * 8 + [9, None]), rng.random() < 0.9, None, None))
    state = empty_set(spark, drafts, ["q0", "q1"])
    outcomes, new = confirmation.confirmation_outcomes(state, spark.createDataFrame(requests, REQUESTS).repartition(3), decisions_of(spark, drafts), T)
    got = sorted((r["ordinal"], r["outcome"]) for r in outcomes.collect())
    want = slow_outcomes(drafts, ["q0", "q1"], requests)
    assert got == want
    assert {o for _, o in want} == {"idempotency-required", "admission-invalid", "draft-version-conflict", "draft-missing", "replay", "corrupt-data", "draft-already-confirmed", "missing-id", "duplicate-id", "committed"}
    committed = [n for n, o in want if o == "committed"]
    assert sorted(r["id"] for r in new.collect()) == sorted(requests[n][5] for n in committed) and len(committed) > 8


def test_confirm_writes_all_or_nothing(spark, tmp_path, monkeypatch):
    root, drafts = str(tmp_path), [draft("d1"), draft("d2", batch="b2"), draft("d3", good=False), draft("d4")]
    commits.commit(spark, root, empty_set(spark, drafts))
    requests = spark.createDataFrame([(n, f"d{n}", "k", "anna", "r", f"q{n}", 1, True, None, None) for n in range(1, 4)], REQUESTS)
    images = spark.createDataFrame([(1, "i0", "new"), (2, "i2", "x"), (3, "i3", "lost")], "ordinal int, id string, src string")
    told = decisions_of(spark, drafts)
    with monkeypatch.context() as broken:
        broken.setattr(confirmation, "_stamped", lambda df, new, key, values: df.withColumn("version", F.raise_error(F.lit("broken"))))
        with pytest.raises(Exception):
            confirmation.confirm(spark, root, requests, told, images, 7, T)
    assert commits.current(spark, root)[0] == 1
    got = sorted(confirmation.confirm(spark, root, requests, told, images, 7, T).collect())
    assert [(r["draft_id"], r["outcome"], r["decision_id"]) for r in got] == [("d1", "committed", "d1:1:k"), ("d2", "committed", "d2:1:k"), ("d3", "admission-invalid", "d3:1:k")]
    state = commits.read_set(spark, root)
    assert sorted((r["id"], r["admission"]["confirmed_by"], r["provenance"]["stem"]["status"], r["confirmed_at"]) for r in state["questions"].collect()) == [("q1", "anna", "manual", T), ("q2", "anna", "manual", T)]
    assert question_schema.validate_questions_v2(state["questions"]).where("valid").count() == 2
    assert sorted((r["id"], r["src"]) for r in state["images"].collect()) == [("i0", "new"), ("i2", "x")]
    assert sorted((r["id"], r["status"], r["version"], r["submitted_question_id"], r["updated_at"]) for r in state["draftQuestions"].collect()) == [("d1", "submitted", 2, "q1", 7), ("d2", "submitted", 2, "q2", 7), ("d3", "new", 1, None, 1), ("d4", "new", 1, None, 1)]
    assert sorted(tuple(r) for r in state["draftImportBatches"].collect()) == [("b1", 1, 7, "d1:1:k"), ("b2", 1, 7, "d2:1:k")]
    again = sorted(confirmation.confirm(spark, root, requests, told, images, 8, T).collect())
    assert [r["outcome"] for r in again] == ["replay", "replay", "admission-invalid"] and commits.current(spark, root)[0] == 2
    assert confirmation.confirm(spark, root, requests.limit(0), told, None, 8, T).count() == 0


def test_backup_findings(spark, tmp_path):
    path = str(tmp_path / "b")
    images = spark.createDataFrame([("1", bytearray(b"abc"), "image/png"), ("2", None, None), ("3", bytearray(b""), "x")], "id string, blob binary, blob_type string")
    assert [tuple(r) for r in backup.backup_findings(spark, path).orderBy("table").collect()] == [("error", "required-file-missing", t, None) for t in ("images", "manifest", "questions")]
    backup.write_backup({"questions": spark.range(3)}, path)
    got = sorted(tuple(r) for r in backup.write_images(images, path).select("id", "blob_type", "blob_size", F.col("blob_file").isNotNull()).collect())
    assert got == [("1", "image/png", 3, True), ("2", None, None, False), ("3", "x", 0, True)]
    assert [tuple(r) for r in backup.backup_findings(spark, path).collect()] == [("warning", "blob-file-unnamed", "images", "2")]
    blobs = spark.read.parquet(f"{path}/blobs")
    keep = blobs.where(F.length("content") == 0).collect()
    spark.createDataFrame(keep, blobs.schema).write.mode("overwrite").parquet(f"{path}/blobs")
    spark.range(4).write.mode("overwrite").parquet(f"{path}/questions")
    spark.createDataFrame([("mergeBatches", 2, "old")], "table string, rows long, schema_version string").write.mode("append").json(f"{path}/manifest")
    found = sorted(tuple(r)[:3] for r in backup.backup_findings(spark, path).collect())
    assert found == [("error", "blob-file-missing", "images"), ("error", "count-mismatch", "blobs"), ("error", "count-mismatch", "questions"), ("error", "table-missing", "mergeBatches"), ("error", "version-invalid", "mergeBatches"), ("warning", "blob-file-unnamed", "images")]


def test_restore_replaces_a_set_at_once(spark, tmp_path):
    path, root = str(tmp_path / "b"), str(tmp_path / "set")
    backup.write_backup({"questions": spark.range(3), "images": spark.range(2)}, path)
    commits.commit(spark, root, {"questions": spark.range(9), "mergeBatches": spark.range(5), "own": spark.range(1)})
    with pytest.raises(ValueError):
        backup.restore_set(spark, path, root, "other")
    assert commits.current(spark, root)[0] == 1
    assert backup.restore_set(spark, path, root) == 2
    assert {n: df.count() for n, df in commits.read_set(spark, root).items()} == {"questions": 3, "images": 2, "mergeBatches": 0}
