"""Extraction in batches with odd extractors; mentions against all places of all names."""

import random
import re

import pytest

from plumbline.operators import entities as E


def odd():
    class Odd:
        """Answers by the first section's text."""

        def extract(self, sections):
            said = sections[0]["text"]
            if said == "raise":
                raise ValueError("no service")
            if said == "fence":
                return '```json\n{"entities": [{"type": "Permit", "text": "p"}]}\n```'
            if said == "nothing":
                return "I found nothing"
            if said == "malformed":
                return {"entities": [{"type": "Deadline", "text": "kept"}, 7], "relations": [{"from": 0, "to": 0}]}
            some = [{"type": "Deadline", "text": "x" * 400, "quote": "q" * 500, "section_id": sections[-1]["section_id"], "dates": ["2024-01-05", "soon", "2024-02-30"], "activity_ids": ["A1", 2]}, {"type": "Person", "text": "y"}, {"type": "Permit", "text": ""}, {"type": "Permit", "text": "z", "section_id": "elsewhere"}]
            links = [{"from": 0, "to": 1, "label": "l" * 99}, {"from": "1", "to": 0}, {"from": 0, "to": 2}, {"from": 1, "to": 1}, {"to": 1}, {"from": -1, "to": 0}]
            return {"entities": some, "relations": links}

    return Odd()


SECTIONS = "project_id long, section_id string, seq int, heading string, page int, text string"


def test_batches_are_validated_and_numbered(spark):
    texts = ["full", None, "raise", "x", "fence", None, "nothing", "x", "malformed", "x", "full"]
    rows = [(p, f"s{i}", i, None, i, t) for p in (1, 2) for i, t in enumerate(texts)] + [(3, "t", 0, None, 1, "raise")]
    raw = E.extracted(spark.createDataFrame(rows, SECTIONS), odd(), batch=2)
    failures = {(r["project_id"], r["batch"]): r["failure"] for r in raw.collect()}
    assert [failures[1, i] is None for i in range(6)] == [True, False, True, False, False, True]
    assert failures[3, 0] == "ValueError: no service"
    found = sorted((r for r in E.entities(raw).collect()), key=lambda r: (r["project_id"], int(r["entity"][4:])))
    one = [r for r in found if r["project_id"] == 1]
    assert [(r["entity"], r["entity_type"], r["section_id"]) for r in one] == [("nar:0", "Deadline", "s1"), ("nar:1", "Permit", "s0"), ("nar:2", "Permit", "s4"), ("nar:3", "Deadline", "s8"), ("nar:4", "Deadline", "s10"), ("nar:5", "Permit", "s10")]
    assert (len(one[0]["text"]), len(one[0]["quote"]), one[0]["dates"], one[0]["activity_ids"]) == (300, 400, ["2024-01-05"], ["A1", "2"])
    assert len(found) == 12
    links = sorted((r["source"], r["target"], r["label"]) for r in E.relations(raw).where("project_id = 2").collect())
    assert links == [("nar:0", "nar:1", "l" * 60), ("nar:1", "nar:0", "relates to"), ("nar:4", "nar:5", "l" * 60), ("nar:5", "nar:4", "relates to")]


def test_no_sections(spark):
    raw = E.extracted(spark.createDataFrame([], SECTIONS))
    assert E.entities(raw).count() == E.relations(raw).count() == 0


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_mentions_are_all_places(spark, most_bytes):
    rng = random.Random(5)
    some = ["a", "b", "Ab", "é", "7", "the"]
    texts = [(rng.randrange(2), i, rng.choice([" ", ", ", "-"]).join(rng.choices(some, k=rng.randrange(40)))) for i in range(120)] + [(0, 200, None), (1, 201, ""), (1, 202, "a a a a")]
    names = [(rng.randrange(2), i, " ".join(rng.choices(some, k=rng.randrange(1, 5)))) for i in range(60)] + [(1, 70, "a A"), (0, 71, None), (1, 72, " - "), (0, 73, "nowhere a")]
    t, n = spark.createDataFrame(texts, "k int, id int, text string"), spark.createDataFrame(names, "k int, name_id int, name string")
    wanted = set()
    for k, i, text in texts:
        for k2, j, name in names:
            w, m = words(text), words(name)
            places = [x for x in range(len(w) - len(m) + 1) if w[x : x + len(m)] == m] if m and k == k2 else []
            if places:
                wanted.add((k, i, j, len(places), places[0]))
    found = E.mentions(t, n, within=["k"], most_bytes=most_bytes)
    assert found.columns == ["k", "id", "name_id", "n", "first"]
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)
    assert E.mentions(t, n.limit(0), within=["k"], most_bytes=most_bytes).count() == E.mentions(t.limit(0), n, within=["k"], most_bytes=most_bytes).count() == 0


def test_long_texts_are_not_shuffled_by_place(spark):
    """Beyond the bound, the words of a text that are shuffled carry its number, not the text itself."""
    texts = spark.createDataFrame([(i, "alpha beta gamma " * 2000 + "rare name alpha") for i in range(20)], "id int, text string")
    names = spark.createDataFrame([(1, "Rare name"), (2, "alpha, alpha"), (3, "gamma alpha"), (4, "nowhere alpha")], "name_id int, name string")
    far = E.mentions(texts, names, most_bytes=0)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, E.mentions(texts, names).collect()))
    plan = far._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(words" not in plan and far.count() == 40
