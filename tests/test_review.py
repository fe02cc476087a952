"""Verified answers, their bounded tries, and reviews with what is missing."""

import plumbline.registry  # noqa: F401  (before its plans)
from plumbline.external import Answer, NumberReviewer
from plumbline.operators import review as V

GOOD = Answer(["A100", "421.03"], ["A100"], False, "text", "schedule", ["sp-1"])


class Scripted:
    """Answers and judgements in turn; an exception in the list is raised."""

    def __init__(self, answers, judgements=()):
        self.answers, self.judgements, self.corrections = list(answers), list(judgements), []

    def answer(self, check, message, correction=None):
        self.corrections.append(correction)
        x = self.answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    def grounded(self, check, message, answer):
        x = self.judgements.pop(0)
        if isinstance(x, Exception):
            raise x
        return x


TEXT = "A100 Clearing [cite:sp-1]\n421.3 applies\n\nCHECK: order"


def test_statuses():
    ok = (True, "")
    clean, open_ = GOOD._replace(breaching=[]), GOOD._replace(breaching=[], insufficient=True)
    for answer, status in ((GOOD, "Fail"), (clean, "Pass"), (open_, "Missing")):
        got = V.judged(Scripted([answer], [ok]), "c", TEXT)
        assert got[0] == status and got[4:] == (2, True, False, False)
    assert V.judged(Scripted([GOOD]), "c", TEXT, judge=False)[4:] == (1, False, False, False)
    failed = V.judged(Scripted([ValueError()]), "c", TEXT)
    assert failed[0] == "Missing" and failed[2] == "error" and failed[4] == 1


def test_items_are_tried_once_more():
    wrong = GOOD._replace(considered=["A10"], breaching=["A10"])
    lost = GOOD._replace(breaching=["B7"])
    r = Scripted([wrong, GOOD], [(True, "")])
    assert V.judged(r, "c", TEXT)[0] == "Fail" and "A10" in r.corrections[1]
    got = V.judged(Scripted([wrong, lost]), "c", TEXT)
    assert got[0] == "Missing" and "[Note:" in got[1] and got[4:] == (2, False, False, False)
    assert V.judged(Scripted([wrong, OSError()]), "c", TEXT)[0] == "Missing"


def test_the_judge_is_asked_twice_at_most():
    clean, no, ok = GOOD._replace(breaching=[]), (False, "why"), (True, "")
    assert V.judged(Scripted([clean, clean], [no, ok]), "c", TEXT)[0] == "Pass"
    got = V.judged(Scripted([clean, clean], [no, no]), "c", TEXT)
    assert got[0] == "Missing" and got[4:] == (4, True, True, True) and "why" in got[1]
    assert V.judged(Scripted([GOOD, GOOD], [no, no]), "c", TEXT)[0] == "Fail"
    assert V.judged(Scripted([clean, OSError()], [no]), "c", TEXT)[0] == "Missing"
    assert V.judged(Scripted([GOOD, GOOD._replace(considered=["zz"], breaching=[])], [no]), "c", TEXT)[0] == "Fail"
    assert V.judged(Scripted([clean], [OSError()]), "c", TEXT)[0] == "Pass"


def test_items_count_as_wholes():
    assert not V.whole_item("M1").search("M100 AM1") and V.whole_item("M1").search("(M1)")
    assert V.whole_item("105.07.01").search("see 105.07.1.") and V.whole_item("105.07.1").search("105.07.01") and not V.whole_item("105.07").search("105.07.01")


def test_missing_sources_and_named_sections(spark):
    checks = [V.Check("a", "llm", ("sp",), 8, "see 7"), V.Check("b", "llm", ("sp", "spec", "csm"), 8, "see 7"), V.Check("c", "date_rule", ("schedule",), None, ""), V.Check("d", "llm", ("utility_plan",), None, "see 5"), V.Check("e", "llm", ("sp", "keymap"), 8, "see 9")]
    projects = spark.createDataFrame([(1,), (2,), (None,)], "project_id int")
    facts = spark.createDataFrame([(1, "schedule", "5 things"), (1, "keymap", None), (2, "keymap", "9")], "project_id int, source string, text string")
    passages = spark.createDataFrame([(1, "a", "sp", "7 [cite:x]", True), (1, "b", "sp", "7 [cite:x]", True), (1, "b", "spec", "t", False), (1, "b", "csm", "u", False), (2, "a", "sp", "8 [cite:y] [cite:y]", False)], "project_id int, check_key string, source string, text string, anchor_missing boolean")
    rules = spark.createDataFrame([(1, "c", True, None), (2, "c", None, "?")], "project_id int, check_key string, satisfied boolean, evidence string")
    got = {(r["project_id"], r["check_key"]): r for r in V.review(projects, checks, rules, facts, passages).collect()}
    assert len(got) == 15
    status = {k: r["status"] for k, r in got.items()}
    assert [status[1, k] for k in "abcde"] == ["Missing", "Pass", "Pass", "Pass", "Missing"] and got[1, "a"]["source"] == "special provision"
    assert [status[2, k] for k in "abcde"] == ["Missing", "Missing", "Missing", "Missing", "Missing"] and got[2, "b"]["evidence"].count(",") == 2
    assert {status[None, k] for k in "abcde"} == {"Missing"}
    assert [tuple(c) for c in got[2, "a"]["citations"]] == [("y", True), ("y", True)] and got[2, "c"]["evidence"] == "?"
    assert V.review(projects.limit(0), checks, rules, facts, passages).count() == 0


def test_the_default_reviewer_reads_numbers():
    a = NumberReviewer().answer("c", "12 and 7\n\nCHECK: 7, 8 and 7")
    assert a.considered == ["7"] and a.insufficient and a.evidence == "7"
