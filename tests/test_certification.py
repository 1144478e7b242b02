"""Certificates: gates, what lies outside of the corpus, files, and what the summary makes of them."""

import json

from fathom import cli
from fathom.plans import certification, summary


def test_a_certificate_with_its_records(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in [
        {"id": "1", "platform": "Enterprise", "gold": ["T1059", "T1003.001"], "predicted": ["T1059.001", "T1003"]},
        {"id": "2", "platform": "enterprise ", "gold": ["T1110"], "predicted": []},
        {"id": "3", "platform": "Mobile", "gold": ["T1400"], "predicted": ["T1500"]},
    ]))
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"id": str(i), "verdict": v}) for i, v in enumerate("CPII")))
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["certify", f"{tmp_path}/t.jsonl", f"{tmp_path}/a.jsonl", f"{tmp_path}/out"]) == 0
    assert "| enterprise |" in capsys.readouterr().out
    made = json.loads((tmp_path / "out" / "certificate.json").read_text())
    own = made["technique"]["enterprise"]
    assert (own["tp"], own["fp"], own["fn"], own["pass"]) == (2, 0, 1, True) and round(own["micro_f1"], 4) == 0.8
    assert made["technique"]["mobile_out_of_corpus"]["mobile"]["micro_f1"] == 0 and made["actor"]["plausible_acc"] == 0.5 and made["actor"]["pass"]
    assert spark.read.json(f"{tmp_path}/out/records").where("id = '2' AND fn = 1").count() == 1
    told = summary.report(summary.capabilities(summary.saved(spark, certificate=f"{tmp_path}/out/certificate.json")))
    assert told["technique_extraction"]["pass"] is True and told["actor_attribution"]["correct"] == 1 and told["generation_grounding"]["status"] == summary.NOT_RUN
    (tmp_path / "none.jsonl").write_text("")
    assert cli.main(["certify", f"{tmp_path}/none.jsonl", f"{tmp_path}/a.jsonl", f"{tmp_path}/out"]) == 1


def test_gates_are_exact(spark):
    rows = spark.createDataFrame([("1", "enterprise", ["T1001", "T1002"], ["T1001"])], "id string, platform string, gold array<string>, predicted array<string>")
    none = spark.createDataFrame([], "id string, verdict string")
    assert certification.certificate(rows, none, (2 / 3, 0.5))["technique"]["enterprise"]["pass"] is True
    assert certification.certificate(rows, none, (0.67, 0.5)) ["technique"]["enterprise"]["pass"] is False
    assert certification.certificate(rows, none)["actor"] == {"pass": False}
