"""The command line on a small workspace."""

import json

import pytest

from cairn import cli

RULES = """types = { type[job] = { path = "game/common/jobs" } }
alias[trigger:has_water] = bool
alias[trigger:job_<job>_add] = bool
job = { size = int }
"""


@pytest.fixture(scope="module")
def places(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    (root / "rules").mkdir()
    (root / "rules" / "base.cwt").write_text(RULES)
    (root / "game" / "common" / "jobs").mkdir(parents=True)
    (root / "game" / "common" / "jobs" / "a.txt").write_text("miner = { size = 1 }\nfarmer = { size = 2 }\n")
    (root / "good.txt").write_text("has_water = yes")
    (root / "bad.txt").write_text("has_watr = yes")
    return root


@pytest.mark.parametrize(
    ("verb", "code", "holds"),
    [
        (["list"], 0, "base.cwt"), (["search", "has_water", "--type", "nothing"], 2, "UNKNOWN_TYPE"), (["get", "farmer"], 0, "FOUND"), (["verify"], 0, "OK"),
        (["search", "has_watr"], 0, "has_water"), (["text", "size"], 0, "miner = { size = 1 }"), (["validate", "good.txt", "--kind", "trigger"], 0, "CWT_IDENTIFIER"), (["validate", "bad.txt", "--kind", "trigger"], 2, "has_water"), (["doctor"], 0, '"n_definitions":2'),
    ],
)
def test_verbs(spark, places, capsys, verb, code, holds):
    verb = [str(places / v) if v.endswith(".txt") else v for v in verb]
    assert cli.main(["--rules", str(places / "rules"), "--data", f"game={places / 'game'}", *verb], spark) == code
    lines = capsys.readouterr().out.strip().splitlines()
    assert all(json.loads(line) for line in lines if line.startswith("{")) and holds in "\n".join(lines)
