from __future__ import annotations

import pytest

from lodestone.operators import references

SCHEMAS = {
    "documents": "answer long, position int, document_id string",
    "evidence": "answer long, position int, evidence_id string, document_id string, status string",
    "facts": "answer long, position int, fact_id string, status string, evidence_ids array<string>",
    "calculations": "answer long, position int, operation string, fact_ids array<string>",
    "claims": "answer long, position int, kind string, operation string, fact_ids array<string>, evidence_ids array<string>",
}
OK = "VERIFIED"
SOUND = {
    "documents": [(1, "d1"), (2, "d2"), (3, "unused")],
    "evidence": [(1, "e1", "d1", OK), (2, "e2", "d2", OK)],
    "facts": [(1, "f1", OK, ["e1"]), (2, "f2", OK, ["e1", "e2"])],
    "calculations": [(1, "RATIO", ["f1", "f2"])],
    "claims": [(1, "FACT", None, ["f1"], ["e1"]), (2, "CALCULATION", "RATIO", ["f2", "f1"], ["e1", "e2"])],
}
BROKEN = [
    ("documents", 0, (1, " "), {("document", "BLANK_ID"), ("evidence-document", "UNKNOWN_DOCUMENT")}),
    ("documents", 2, (3, "d1"), {("document", "REPEATED_ID")}),
    ("evidence", 1, (2, "e1", "d2", OK), {("evidence", "REPEATED_ID"), ("fact-evidence", "UNKNOWN_EVIDENCE"), ("claim-evidence", "UNKNOWN_EVIDENCE")}),
    ("evidence", 1, (2, "e2", "nowhere", OK), {("evidence-document", "UNKNOWN_DOCUMENT")}),
    ("evidence", 1, (2, "e2", "d2", "CANDIDATE"), {("fact-evidence", "UNVERIFIED_EVIDENCE")}),
    ("facts", 1, (2, "f2", None, ["e1", "e2"]), {("fact-evidence", "UNVERIFIED_FACT"), ("calculation-fact", "UNVERIFIED_FACT"), ("claim-fact", "UNVERIFIED_FACT")}),
    ("facts", 1, (2, "f2", OK, None), {("fact-evidence", "FACT_WITHOUT_EVIDENCE")}),
    ("facts", 1, (2, "f2", OK, ["e1", "e2", "e9"]), {("fact-evidence", "UNKNOWN_EVIDENCE"), ("claim-proof", "MISSING_PROOF")}),
    ("calculations", 0, (1, "RATIO", ["f1", "f9"]), {("calculation-fact", "UNKNOWN_FACT"), ("claim-calculation", "NO_SINGLE_CALCULATION")}),
    ("calculations", 0, (1, "SUM", ["f1", "f2"]), {("claim-calculation", "NO_SINGLE_CALCULATION")}),
    ("claims", 0, (1, "FACT", None, ["f9"], ["e1"]), {("claim-fact", "UNKNOWN_FACT")}),
    ("claims", 0, (1, "FACT", None, ["f1"], ["e1", "e9"]), {("claim-evidence", "UNKNOWN_EVIDENCE")}),
    ("claims", 0, (1, "FACT", None, ["f1"], None), {("claim-proof", "MISSING_PROOF")}),
]


@pytest.fixture(scope="module")
def frames(spark):
    """Answer 0 is sound; answer k has the k-th of BROKEN."""
    made = {}
    for name, schema in SCHEMAS.items():
        rows = []
        for answer in range(len(BROKEN) + 1):
            for k, row in enumerate(SOUND[name]):
                where, at, other, _ = BROKEN[answer - 1] if answer else (None, None, None, None)
                rows.append((answer, *(other if (name, k) == (where, at) else row)))
        made[name] = spark.createDataFrame(rows, schema).repartition(3)
    return made


def test_each_relation_broken_once(frames):
    got: dict[int, set] = {}
    for r in references.problems(**frames).collect():
        got.setdefault(r.answer, set()).add((r.check, r.problem))
    assert got == {k: want for k, (*_, want) in enumerate(BROKEN, 1)}


def test_first_problem_of_each_answer(frames):
    first = {r.answer: (r.check, r.problem) for r in references.first_problems(references.problems(**frames)).collect()}
    for k, (*_, want) in enumerate(BROKEN, 1):
        assert first[k] == min(want, key=lambda p: references.CHECKS.index(p[0]))
    assert 0 not in first


def test_two_equal_calculations_are_not_one(spark, frames):
    twice = frames["calculations"].where("answer = 0").union(frames["calculations"].where("answer = 0"))
    given = {k: v.where("answer = 0") for k, v in frames.items()} | {"calculations": twice}
    assert [(r.position, r.problem) for r in references.problems(**given).collect()] == [(2, "NO_SINGLE_CALCULATION")]


def test_used_documents_and_kept_first(spark, frames):
    used = references.used_documents(frames["documents"], frames["evidence"], frames["claims"]).where("answer = 0")
    assert sorted(r.document_id for r in used.collect()) == ["d1", "d2"]
    rows = spark.createDataFrame([(1, 3, "a"), (1, 2, "a"), (1, 1, None), (2, 5, "a"), (1, 4, "b"), (1, 9, "")], SCHEMAS["documents"])
    kept = references.kept_first(rows, "document")
    assert kept.columns == rows.columns
    assert sorted(map(tuple, kept.collect())) == [(1, 2, "a"), (1, 4, "b"), (2, 5, "a")]


def test_empty_frames(spark):
    empty = {k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
    assert references.problems(**empty).count() == 0
    assert references.first_problems(references.problems(**empty)).count() == 0


def test_answers_that_are_dealt_already_move_once(spark, frames):
    """Things and edges meet without joins, and each frame is read once."""
    dealt = {k: v.repartition(4, "answer") for k, v in frames.items()}
    plan = references.problems(**dealt)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == len(frames)
    dealt_by_name = references.problems(**frames)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in dealt_by_name and dealt_by_name.count("Exchange hashpartitioning(answer") == 2


def test_names_that_are_null_or_said_twice(spark):
    made = {
        "documents": [(1, 1, None)],
        "evidence": [(1, 1, "e1", None, OK), (1, 2, "e2", "d", OK)],
        "facts": [(1, 1, "f", OK, ["e1"]), (1, 2, "f", OK, ["e2", None])],
        "calculations": [(1, 1, None, ["f"])],
        "claims": [(1, 1, "CALCULATION", None, ["f", "g", "g"], ["e1", None])],
    }
    got = sorted(map(str, references.problems(**{k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in made.items()}).drop("answer").collect()))
    want = [
        ("document", 1, None, "BLANK_ID"), ("fact", 2, "f", "REPEATED_ID"), ("evidence-document", 1, None, "UNKNOWN_DOCUMENT"), ("evidence-document", 2, "d", "UNKNOWN_DOCUMENT"),
        ("fact-evidence", 2, None, "UNKNOWN_EVIDENCE"), ("claim-fact", 1, "g", "UNKNOWN_FACT"), ("claim-fact", 1, "g", "UNKNOWN_FACT"), ("claim-evidence", 1, None, "UNKNOWN_EVIDENCE"),
        ("claim-proof", 1, "e2", "MISSING_PROOF"), ("claim-proof", 1, None, "MISSING_PROOF"), ("claim-calculation", 1, None, "NO_SINGLE_CALCULATION"),
    ]
    assert got == sorted(f"Row(check={c!r}, position={p}, id={i!r}, problem={x!r})" for c, p, i, x in want)
