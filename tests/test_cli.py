import json

import pytest

from spanloom.catalog import Pattern
from spanloom.cli import main
from spanloom.plans.harness import allowed_profile, try_patterns


def test_analyze(spark, capsys, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("MNPI inside")
    assert main(["analyze", "nothing", "--file", str(path), "--profile", "finance"]) == 0
    assert json.loads(capsys.readouterr().out)["routing_suggestion"] == "LOCAL_ONLY"
    main(["analyze", "nothing here", "--profile", "finance", "--form", "summary"])
    assert capsys.readouterr().out.startswith("NONE (0) | CLOUD_OK")


def test_other_commands(spark, capsys):
    main(["profiles"])
    assert "therapy-pro" in capsys.readouterr().out
    main(["try", r"\bUK-\d+\b", "see UK-42", "nothing"])
    assert "UK-42" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_harness_filters_by_score(spark):
    p = [Pattern("A", "A", "a", 0.4, "a+"), Pattern("B", "B", "b", 0.6, "b+")]
    assert [(r.category, r.found) for r in try_patterns(spark, p, ["aabb"]).collect()] == [("B", "bb")]


def test_allowed_profile():
    assert allowed_profile(None, "legal").id == "legal" and allowed_profile("", "finance").id == "finance"
    with pytest.raises(ValueError):
        allowed_profile("vendor-legal", "legal")
