"""Every safety check of a rewrite with a case on both sides, overlaps and re-scans against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sourcegrain.operators import remediate as L
from sourcegrain.operators import rules as R

PROP = ("proposal_id string, repo_id string, path string, number long, line int, finding_line int, rule_id string, before array<string>, after array<string>, "
        "kind string, language string")
LINES = ["const a = 1", "const url = 'http://api.shop.test/x'", "run(a)", "stop(a)", "el.innerHTML = name", "last()", "more()", "end()"]


def props(spark, *rows):
    """Rows of (id, line, before, after), with optional finding line, path and rule."""
    full = [(r["id"], "r", r.get("path", "a.js"), r.get("number", 1), r["line"], r.get("finding", r["line"]), r.get("rule", "insecure-http"), r["before"], r["after"],
             "source", "javascript") for r in rows]
    return spark.createDataFrame(full, PROP)


def files(spark, lines=LINES):
    return spark.createDataFrame([("r", "a.js", lines)], "repo_id string, path string, lines array<string>")


URL = "const url = 'https://api.shop.test/x'"
REASONS = {
    None: dict(line=2, before=LINES[1:2], after=[URL]),
    "file missing": dict(line=2, before=LINES[1:2], after=[URL], path="gone.js"),
    "source mismatch": dict(line=3, before=LINES[1:2], after=[URL]),
    "line count": dict(line=2, before=LINES[1:2], after=[URL, "x()"]),
    "too many lines": dict(line=1, before=LINES[:7], after=["x()", *LINES[1:7]]),
    "no change": dict(line=2, before=LINES[1:2], after=LINES[1:2]),
    "out of scope": dict(line=2, finding=3, before=LINES[1:2], after=[URL]),
    "line break": dict(line=2, before=LINES[1:2], after=["a()\nb()"]),
    "placeholder": dict(line=2, before=LINES[1:2], after=["key = '[REDACTED]'"]),
    "new credential": dict(line=2, before=LINES[1:2], after=["const password = 'hunter2hunter2'"]),
    "new execution": dict(line=2, before=LINES[1:2], after=["eval(url)"]),
    "too large": dict(line=2, before=LINES[1:2], after=["x" * 4001]),
}


def test_each_reason_is_told_and_the_sound_rewrite_passes(spark):
    rows = [{"id": str(reason), **case} for reason, case in REASONS.items()]
    rows += [{"id": "past the end", "line": 8, "before": LINES[7:], "after": ["fin()"]}, {"id": "far", "line": 1, "finding": 6, "before": LINES[:6], "after": ["x()", *LINES[1:5], "y()"]},
             {"id": "six lines", "line": 1, "finding": 1, "before": LINES[:6], "after": ["x()", *LINES[1:6]]}, {"id": "just fits", "line": 2, "before": LINES[1:2], "after": ["x" * 4000]}]
    got = {r.proposal_id: r.rejection for r in L.review(props(spark, *rows), files(spark)).collect()}
    assert got == {**{str(reason): reason for reason in REASONS}, "past the end": None, "far": "out of scope", "six lines": None, "just fits": None}


def test_old_credentials_and_calls_do_not_count_as_new(spark):
    lines = ["const password = 'hunter2hunter2'", "eval(a)"]
    rows = [{"id": "secret", "line": 1, "before": lines[:1], "after": ["const password = 'hunter3hunter3'"]}, {"id": "call", "line": 2, "before": lines[1:], "after": ["eval(b)"]}]
    assert {r.rejection for r in L.review(props(spark, *rows), files(spark, lines)).collect()} == {None}


def plain_overlaps(rows):
    lost, taken = set(), {}
    for r in sorted(rows, key=lambda r: (r["number"], r["id"])):
        span = {(r["path"], n) for n in range(r["line"], r["line"] + len(r["after"]))}
        if r["rejection"] is None and span & taken.keys():
            lost.add(r["id"])
        elif r["rejection"] is None:
            taken.update(dict.fromkeys(span))
    return lost


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_against_a_plain_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        n = rng.randint(1, 5)
        rows.append({"id": f"p{i}", "path": rng.choice(["a.js", "b.js"]), "number": rng.randint(1, 120), "line": rng.randint(1, 130), "before": ["x"] * n, "after": ["y"] * n,
                     "rejection": rng.choice([None, None, None, "no change"])})
    reasons = spark.createDataFrame([(r["id"], r["rejection"]) for r in rows], "proposal_id string, rejection string")
    out = L.reject_overlaps(props(spark, *rows).join(reasons, "proposal_id")).collect()
    lost = plain_overlaps(rows)
    assert len(out) == len(rows) and lost
    assert {r.proposal_id: r.rejection for r in out} == {r["id"]: "overlap" if r["id"] in lost else r["rejection"] for r in rows}


def test_overlaps_of_nothing(spark):
    assert L.reject_overlaps(props(spark).withColumn("rejection", F.lit(None).cast("string"))).count() == 0


def scanned(spark, lines):
    rows = [("r", "a.js", i + 1, text, "source", "javascript") for i, text in enumerate(lines)]
    return R.scan_lines(spark.createDataFrame(rows, "repo_id string, path string, line_no int, line string, kind string, language string"))


def test_rescan_against_a_scan_of_the_whole_patched_file(spark):
    lines = [*LINES, "eval(userInput)", "el.innerHTML = other"]
    rows = [
        {"id": "good", "line": 2, "before": lines[1:2], "after": [URL]},
        {"id": "still", "line": 2, "before": lines[1:2], "after": ["const url = 'http://api.shop.test/y'"]},
        {"id": "brings", "line": 5, "rule": "dom-xss", "before": lines[4:5], "after": ["eval(name)"]},
        {"id": "moves", "line": 2, "before": lines[1:3], "after": ["run(a)", "eval(userInput)"]},
        {"id": "two", "line": 1, "before": lines[:5], "after": ["crypto.createHash('md5')", URL, "eval(a)", "stop(a)", "el.textContent = name"]},
        {"id": "swaps", "line": 4, "rule": "dom-xss", "before": lines[3:5], "after": ["el.innerHTML = name", "stop(a)"]},
    ]
    out = {r.proposal_id: (r.status, r.rejection) for r in L.verify_by_rescan(props(spark, *rows), scanned(spark, lines)).collect()}
    for r in rows:
        new = lines[:r["line"] - 1] + r["after"] + lines[r["line"] - 1 + len(r["after"]):]
        before, after = (Counter((h.rule_id, h.evidence) for h in scanned(spark, text).collect()) for text in (lines, new))
        target = r.get("rule", "insecure-http")
        inside = {h.rule_id for h in scanned(spark, new).collect() if r["line"] <= h.line_no < r["line"] + len(r["after"])}
        brought = sorted({rule for rule, _ in after - before})
        want = "rule still matches" if target in inside else "introduces " + ", ".join(brought) if brought else None
        assert out[r["id"]] == ("rejected" if want else "verified", want), r["id"]
    assert {s for s, _ in out.values()} == {"verified", "rejected"} and out["two"][1].count(",") >= 1 and out["moves"][0] == "rejected"
