import pytest

from lexsift.functions.text import literal_grams
from lexsift.plans.planner import CostModel, plan, validate
from lexsift.plans.query import Case, Mode, Query, exit_status, last_case, last_mode
from lexsift.plans.regex import PatternError
from lexsift.queries.candidates import PLANS


@pytest.mark.parametrize("pattern, fixed, folded, word, kind, grams", PLANS)
def test_plans(pattern, fixed, folded, word, kind, grams):
    chosen = plan(Query((pattern,), fixed=fixed, word=word, case=Case.INSENSITIVE if folded else Case.SENSITIVE))
    assert (chosen.kind, len(chosen.grams)) == (kind, grams)


def test_several_patterns_scan():
    assert plan(Query(("plum", "pear"), fixed=True)).kind == "scan"


def test_literal_grams():
    assert literal_grams("melon") == ["6D656C", "656C6F", "6C6F6E"]
    assert len(literal_grams("figfig")) == 3 and literal_grams("ab") == [] and literal_grams("é") == []


def test_cost_model():
    model = CostModel()
    assert model.prefers_scan(128, 131072, 64)
    assert not model.prefers_scan(127, 131072, 64)
    assert not model.prefers_scan(128, 131072, 63)
    assert not model.prefers_scan(128, 128 * 65536 + 1, 64)


def test_flags():
    assert last_mode(["-c", "-l"]) is Mode.FILES and last_mode(["-l", "-c"]) is Mode.COUNT and last_mode(["-l", "-q"]) is Mode.QUIET
    assert last_case([], ["--smart-case"]) is Case.SMART and last_case(["-s"], ["-i"]) is Case.SENSITIVE
    assert [exit_status(True, False), exit_status(False, False), exit_status(True, True), exit_status(True, True, True)] == [0, 1, 2, 0]


def test_validation():
    with pytest.raises(PatternError):
        validate(Query((r"\n",)))
    with pytest.raises(ValueError):
        Query(("a\nb",), fixed=True)
    with pytest.raises(ValueError):
        Query(())
