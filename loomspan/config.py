"""Settings of compression, checked when made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

GRANULARITIES = ("per_tensor", "per_channel", "blockwise")
POLICIES = ("minmax", "per_channel", "blockwise", "percentile")
#: Calibration policies that go with a granularity.
ALLOWED = {"per_tensor": {"minmax", "percentile"}, "per_channel": {"minmax", "per_channel", "percentile"}, "blockwise": {"minmax", "blockwise", "percentile"}}


@dataclass(frozen=True)
class Config:
    bits: int = 4
    mode: str = "symmetric"
    lossless: bool = False
    granularity: str = "per_channel"
    policy: str = "minmax"
    percentile: float = 99.9
    block_size: int = 128
    axis: int = 0
    coder: str = "rans"
    layout: str = "lanes"
    pack_bits: bool = False
    chunk_size: int = 1 << 20
    delta_bits: int = 2
    variance: float = 0.95

    def __post_init__(self) -> None:
        wrong = [
            text
            for bad, text in (
                (not 1 <= self.bits <= 32, "bits must be 1 to 32"),
                (self.mode not in ("symmetric", "asymmetric", "none"), f"no such mode: {self.mode}"),
                (self.mode == "none" and not self.lossless, "mode none is for lossless compression"),
                (self.mode == "symmetric" and self.bits == 1 and not self.lossless, "one symmetric bit has three codes; use 2 bits or the asymmetric mode"),
                (self.granularity not in GRANULARITIES, f"no such granularity: {self.granularity}"),
                (self.policy not in POLICIES, f"no such policy: {self.policy}"),
                (self.granularity in ALLOWED and self.policy in POLICIES and self.policy not in ALLOWED[self.granularity], f"{self.policy} does not go with {self.granularity}"),
                (not 0 < self.percentile <= 100, "percentile must be above 0, up to 100"),
                (self.block_size < 1, "block_size must be 1 or more"),
                (self.coder not in ("rans", "raw"), f"no such coder: {self.coder}"),
                (self.layout not in ("lanes", "single"), f"no such layout: {self.layout}"),
                (self.chunk_size < 1, "chunk_size must be 1 or more"),
                (not 0 < self.variance <= 1, "variance must be above 0, up to 1"),
            )
            if bad
        ]
        if wrong:
            raise ValueError("; ".join(wrong))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Unknown keys raise."""
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**given)

    def to_yaml(self) -> str:
        return "".join(f"{k}: {json.dumps(v)}\n" for k, v in sorted(asdict(self).items()))

    @classmethod
    def from_yaml(cls, text: str) -> Config:
        """A flat mapping, a setting a line."""
        rows = [line.partition(":") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]

        def value(v: str) -> object:
            try:
                return json.loads(v)
            except ValueError:
                return v.strip("'\"")

        return cls.from_json(json.dumps({k.strip(): value(v.strip()) for k, _, v in rows}))
