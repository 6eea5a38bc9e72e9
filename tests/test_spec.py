import json

import pytest

from clipmill import ExportSpec, SplitPolicy
from clipmill.spec import parse_ratios


@pytest.mark.parametrize(
    "raw, reserved, expected",
    [
        ("0.8,0.1,0.1", False, (0.8, 0.1, 0.1)),
        (" 0.8, 0.1 ,0.1", False, (0.8, 0.1, 0.1)),
        ("0.9,0.1", True, (0.9, 0.1, 0.0)),
        ("0.8,0.2,0", True, (0.8, 0.2, 0.0)),
        ("1,0,0", False, (1.0, 0.0, 0.0)),
    ],
)
def test_ratios_accepted(raw, reserved, expected):
    assert parse_ratios(raw, reserved) == expected


@pytest.mark.parametrize(
    "raw, reserved",
    [
        ("0.5,0.5,0.5", False),
        ("0.5,0.5", False),
        ("0.7,0.1,0.2", True),
        ("0.5,0.4", True),
        ("1", False),
        ("0.5,0.2,0.2,0.1", False),
        ("a,b,c", False),
        ("1.5,-0.5,0", False),
        ("nan,0.5,0.5", False),
    ],
)
def test_ratios_refused(raw, reserved):
    with pytest.raises(ValueError):
        parse_ratios(raw, reserved)


def test_unknown_split_kind_is_refused():
    with pytest.raises(ValueError, match="by_moon"):
        SplitPolicy("by_moon")


def test_spec_json_omits_unset_fields():
    body = json.loads(ExportSpec("p1", "n", label_set_id="ls").to_json())
    assert body == {
        "name": "n",
        "filter": {"labelSetId": "ls", "reviewStatuses": ["approved"]},
        "splitPolicy": {"kind": "random", "seed": 42, "ratios": [0.8, 0.1, 0.1]},
    }


def test_spec_json_keeps_set_fields():
    spec = ExportSpec(
        "p1", "n", "d", review_statuses=("rejected",), label_keys=("a",), labeller_ids=(7,),
        created_at_from="2024-01-01T00:00:00Z", use_reserved_test_files=False,
    )
    body = json.loads(spec.to_json("ls2"))
    assert body["description"] == "d"
    assert body["filter"] == {
        "labelSetId": "ls2",
        "reviewStatuses": ["rejected"],
        "labelKeys": ["a"],
        "labellerIds": [7],
        "createdAtFrom": "2024-01-01T00:00:00Z",
        "useReservedTestFiles": False,
    }


@pytest.mark.parametrize("ratios", [(5, -3, 9), (0.5, 0.4, 0.2), (0.5, 0.5), (float("nan"), 0.5, 0.5), (0.2, 0.2, 0.2)])
def test_a_policy_refuses_what_the_text_refuses(ratios):
    with pytest.raises(ValueError):
        SplitPolicy(ratios=ratios)


@pytest.mark.parametrize("ratios, fits", [((0.8, 0.1, 0.1), False), ((0.0, 0.0, 1.0), False), ((0.9, 0.1, 0.0), True), ((1.0, 0.0, 0.0), True)])
def test_a_reserved_export_leaves_the_test_share_empty(ratios, fits):
    make = lambda: ExportSpec("p", "n", use_reserved_test_files=True, split=SplitPolicy(ratios=ratios))
    if fits:
        assert make().split.ratios == ratios
    else:
        with pytest.raises(ValueError, match="test ratio"):
            make()
    assert ExportSpec("p", "n", split=SplitPolicy(ratios=ratios)).split.ratios == ratios
