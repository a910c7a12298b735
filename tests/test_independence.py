import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "shardloom"


def test_nothing_imports_the_subpackage():
    for p in ROOT.rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"shardloom\.llm|from shardloom import llm", p.read_text()), p


def test_no_local_checkpoint():
    assert not any("localCheckpoint" in p.read_text() for p in ROOT.rglob("*.py"))
