"""Whole decisions of a reviewer, one thing wrong at a time."""

import copy
import json

from prospector.functions import decisions

GOOD = {
    "verdict": "YES", "confidence": "high", "rationale": "it is", "root_cause": "r", "attacker_preconditions": "p", "impact": "i", "fix_effect": "f", "l0_class": "injection", "cwe_id": "cwe-79", "severity": {"level": "high", "source": "human"},
    "fix_completeness": "single", "reachability_delta": {"verdict": "narrows", "before": "b", "after": "a"}, "failure_containment": "n/a", "affected_paths": ["x.py"],
    "evidence": [{"revision": "commit", "path": "x.py", "start_line": 2, "end_line": 2, "quoted_span": " safe(x) ", "supports": [*decisions.CLAIMED, "cwe_id"]}],
}


def test_decisions(spark):
    def but(**changes):
        out = copy.deepcopy(GOOD)
        for k, v in changes.items():
            if v is None:
                out.pop(k)
            else:
                out[k] = v
        return out

    ev = lambda **c: [{**GOOD["evidence"][0], **c}]
    cases = {
        "good": (GOOD, []), "no": ({"verdict": "no", "confidence": "low", "rationale": "n", "impact": "dropped"}, []), "abstain": ({"verdict": "ABSTAIN", "confidence": "low", "rationale": "n"}, ["ABSTAIN without a reason"]),
        "flag": ({"is_security_fix": False, "confidence": "low", "rationale": "n", "abstain_reason": "x"}, ["NO with a reason to abstain"]), "text": ("nothing", ["not a JSON object", "unknown verdict", "unknown confidence", "no rationale"]),
        "extra": (but(score=1), ["unknown fields"]), "thinking": (but(thinking="hm"), ["reasoning is prohibited"]), "long": (but(rationale="x" * 1201), ["rationale too long"]), "cause": (but(root_cause=7), ["YES without root_cause"]),
        "class": (but(l0_class="magic"), ["unknown class"]), "cwe": (but(cwe_id="79"), ["weakness not as CWE-N"]), "unlisted": (but(cwe_id="CWE-1"), ["weakness not in the catalogue"]), "advisory": (but(severity={"level": "low", "source": "advisory"}), ["severity of an advisory in A0"]),
        "score": (but(severity={"level": "low", "source": "cvss", "score": "9"}), ["score not 0 to 10"]), "vector": (but(severity={"level": "low", "source": "human", "vector": "v"}), ["vector without cvss"]),
        "widens": (but(reachability_delta={"verdict": "widens", "before": "b", "after": "a"}), [decisions.GATES[0]]), "contained": (but(failure_containment="contained"), [decisions.GATES[1]]), "paths": (but(affected_paths=["x.py", "/y"]), ["path not relative", "a path without evidence"]),
        "quote": (but(evidence=ev(quoted_span="other")), ["no verified evidence", "a path without evidence", "a claim without evidence", "a quote that is not in the lines"]), "claims": (but(evidence=ev(supports=["impact"])), ["a claim without evidence"]),
        "elsewhere": (but(evidence=ev(revision_sha="ffffffff")), ["no verified evidence", "a path without evidence", "a claim without evidence", "evidence of another revision"]), "invariant": (but(invariant="holds"), ["a claim without evidence"]),
    }
    rows = [(k, json.dumps(d) if isinstance(d, dict) else d, "c" * 40, "p" * 40) for k, (d, _) in cases.items()]
    df = spark.createDataFrame(rows, "k string, answer string, commit string, parent string")
    blobs = spark.createDataFrame([("c" * 40, "x.py", "one\nsafe(x)\n")], "sha string, path string, content string")
    evidence = decisions.verified_evidence(df, "k", "answer", blobs, "commit", "parent")
    got = {r["k"]: r for r in decisions.validated(df, "k", "answer", evidence, ["CWE-79"]).collect()}
    assert {k: list(r["problems"]) for k, r in got.items()} == {k: p for k, (_, p) in cases.items()}
    assert {k for k, r in got.items() if r["gate_rejected"]} == {"widens", "contained"} and got["good"]["evidence"][0]["revision_sha"] == "c" * 40
