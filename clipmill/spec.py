"""What an export asks for: annotation filter plus split policy."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from clipmill.schemas import DEFAULT_SEED, SPLIT_KINDS

RATIO_TOLERANCE = 1e-6


def check_ratios(shares: tuple[float, ...], reserved: bool = False) -> tuple[float, float, float]:
    """The shares of train, validation and test, or an error.

    With reserved test files the test share comes from those files, so it must be left out or 0.
    """
    if any(not math.isfinite(share) or share < 0 for share in shares):
        raise ValueError(f"ratios must be finite and not negative, got {shares}")
    if len(shares) != 3 and not (reserved and len(shares) == 2):
        raise ValueError(f"three ratios are needed (two if test files are reserved), got {shares}")
    if reserved:
        if len(shares) == 3 and shares[2] > RATIO_TOLERANCE:
            raise ValueError(f"with reserved test files the test ratio must be 0, got {shares}")
        shares = (shares[0], shares[1], 0.0)
    if abs(math.fsum(shares) - 1.0) > RATIO_TOLERANCE:
        raise ValueError(f"ratios must sum to 1.0, got {shares}")
    return tuple(shares)


def parse_ratios(raw: str, reserved: bool = False) -> tuple[float, float, float]:
    """Read ``"train,validation,test"`` shares, with reserved test files also a pair."""
    texts = [part.strip() for part in raw.split(",")]
    if len(texts) not in (2, 3):
        raise ValueError(f"ratios need two or three comma-separated numbers, got {raw!r}")
    try:
        shares = [float(text) for text in texts]
    except ValueError as bad:
        raise ValueError(f"ratios {raw!r} hold something that is not a number: {bad}") from None
    return check_ratios(tuple(shares), reserved)


@dataclass(frozen=True)
class SplitPolicy:
    kind: str = "random"
    seed: int = DEFAULT_SEED
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)

    def __post_init__(self):
        if self.kind not in SPLIT_KINDS:
            raise ValueError(f"unknown split kind {self.kind!r}; expected one of {SPLIT_KINDS}")
        check_ratios(tuple(self.ratios))


@dataclass(frozen=True)
class ExportSpec:
    """Filter and split of one export. Empty lists and ``None`` mean "no restriction", except
    review statuses, where empty means approved only."""

    project_id: str
    name: str
    description: str | None = None
    label_set_id: str | None = None
    review_statuses: tuple[str, ...] = ()
    label_keys: tuple[str, ...] = ()
    labeller_ids: tuple[int, ...] = ()
    created_at_from: str | None = None
    created_at_to: str | None = None
    use_reserved_test_files: bool | None = None
    split: SplitPolicy = field(default_factory=SplitPolicy)

    def __post_init__(self):
        check_ratios(tuple(self.split.ratios), self.use_reserved_test_files is True)

    @property
    def statuses(self) -> tuple[str, ...]:
        return tuple(self.review_statuses) or ("approved",)

    def to_json(self, label_set_id: str | None = None) -> str:
        """Compact camelCase JSON; unset fields are left out."""
        wanted = {
            "labelSetId": label_set_id or self.label_set_id,
            "reviewStatuses": list(self.statuses),
            "labelKeys": list(self.label_keys) or None,
            "labellerIds": list(self.labeller_ids) or None,
            "createdAtFrom": self.created_at_from,
            "createdAtTo": self.created_at_to,
            "useReservedTestFiles": self.use_reserved_test_files,
        }
        body = {
            "name": self.name,
            "description": self.description,
            "filter": {k: v for k, v in wanted.items() if v is not None},
            "splitPolicy": {
                "kind": self.split.kind,
                "seed": self.split.seed,
                "ratios": [float(r) for r in self.split.ratios],
            },
        }
        return json.dumps(
            {k: v for k, v in body.items() if v is not None},
            separators=(",", ":"),
            ensure_ascii=False,
        )
