"""Options of a run, as keywords or as command-line arguments."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields


@dataclass
class Options:
    output_dir: str
    k_mer_size: int
    reads: list[str] = field(default_factory=list)
    window: int = 2000
    base: int = 239
    compress: bool = False
    on_invalid: str = "error"
    reference: str | None = None
    dbg: str | None = None
    coverages: str | None = None
    stages: str | None = None
    coverage: bool = False
    align: list[str] = field(default_factory=list)
    segments: str | None = None
    tip_correct: bool = False
    simplify: bool = False
    cov_threshold: float = 2
    correct: bool = False

    def __post_init__(self):
        self.k_mer_size += 1 - self.k_mer_size % 2
        if not self.output_dir or self.k_mer_size < 1:
            raise ValueError("output_dir and k_mer_size are required")


def parse(args: list[str]) -> Options:
    p = argparse.ArgumentParser("strandwise")
    p.add_argument("-o", "--output-dir", required=True)
    p.add_argument("-k", "--k-mer-size", type=int, required=True)
    p.add_argument("-w", "--window", type=int, default=2000)
    p.add_argument("--base", type=int, default=239)
    p.add_argument("--reads", action="append", default=[])
    p.add_argument("--align", action="append", default=[])
    p.add_argument("--on-invalid", choices=["error", "split", "drop"], default="error")
    p.add_argument("--cov-threshold", type=float, default=2)
    for name in ("reference", "dbg", "coverages", "stages", "segments"):
        p.add_argument(f"--{name}")
    for name in ("compress", "coverage", "tip-correct", "simplify", "correct"):
        p.add_argument(f"--{name}", action="store_true")
    known = {f.name for f in fields(Options)}
    return Options(**{k: v for k, v in vars(p.parse_args(args)).items() if k in known})
