import json

import pytest

from strandwise import __main__ as C
from strandwise.config import Settings


def parsed(*argv):
    args = C.parser().parse_args(argv)
    settings = C.settings_of(args)
    return settings, C.paths_of(args, settings)


def test_defaults():
    settings, paths = parsed("retrieve", "--root", "/r", "--dataset", "2wiki")
    assert settings == Settings(dataset="2wiki")
    assert paths == {"data": "/r/2wiki/data.json", "plan": "/r/2wiki/plan", "kg": "/r/2wiki/kg", "out": "/r/2wiki/out"}


def test_settings_and_paths(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"relation_k": 5, "top_n": 4}))
    settings, paths = parsed("evaluate", "--config", str(tmp_path / "c.json"), "--top_n", "2", "--neff_threshold", "2.5", "--strict_recall", "true", "--num_samples", "none", "--recall_ks", "1,3", "--id_keys", "qid", "--out", "o")
    assert settings == Settings(relation_k=5, top_n=2, neff_threshold=2.5, strict_recall=True, num_samples=None, recall_ks=(1, 3), id_keys=("qid",))
    assert paths["out"] == "o"


@pytest.mark.parametrize("argv", [["other"], ["plan", "--dataset", "none"], ["plan", "--max_rounds", "2"]])
def test_unknown_options(argv):
    with pytest.raises(SystemExit):
        C.parser().parse_args(argv)
