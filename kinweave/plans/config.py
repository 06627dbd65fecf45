"""Run parameters and the genomic interval notation."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

LOWEST, HIGHEST = -(1 << 31), (1 << 31) - 1


@dataclass(frozen=True)
class Interval:
    chrom: str
    start: int = LOWEST
    end: int = HIGHEST


def parse_interval(text: str) -> Interval:
    """``c``, ``c:``, ``c:s`` (one position), ``c:s-``, ``c:-e`` or ``c:s-e``; the last colon parts the chromosome."""
    chrom, colon, span = text.strip().rpartition(":")
    if not colon:
        chrom, span = span, ""
    found = re.fullmatch(r"(\d*)(-?)(\d*)", span)
    if not chrom or not found:
        raise ValueError(f"not an interval: {text!r}")
    first, dash, last = found.groups()
    start = int(first) if first else LOWEST
    end = int(last) if last else (HIGHEST if dash or not first else start)
    if start > end:
        raise ValueError(f"not an interval: {text!r}")
    return Interval(chrom, start, end)




#: name -> (least, most), both allowed
_RANGES = {
    "min_maf": (1e-45, 0.5), "min_ibs_cm": (1e-45, 3e38), "min_ibd_cm": (1e-45, 3e38), "pbwt": (1, 1 << 30), "trim": (0, 3e38),
    "discord": (1e-45, 1 - 1e-8), "out_cm": (1e-45, 3e38), "ne": (1, 3e38), "quantile": (1e-45, 1 - 1e-8), "gc_bases": (0, 1 << 30),
    "gc_discord": (1e-45, 1 - 1e-8), "local_segments": (1, 45000), "local_max_cdf": (1e-45, 1 - 1e-8), "global_loci": (1, 1 << 30),
    "global_segments": (1, 1 << 30), "global_quantile": (1e-45, 1 - 1e-8), "global_multiple": (1e-45, 3e38), "min_cdf_ratio": (1e-45, 3e38),
    "max_its": (1, 1 << 30), "end_morgans": (0, 3e38), "prefocus_quantile": (1e-45, 1 - 1e-8), "max_rel_diff": (1e-45, 1 - 1e-8), "out_window_size": (1, 1 << 30),
}


@dataclass(frozen=True)
class Parameters:
    """Everything a run can be told; fractions are used as 32-bit floats where results depend on it."""

    gt: str = ""
    map: str = ""
    out: str = ""
    chrom: str | None = None
    excludesamples: str | None = None
    excludemarkers: str | None = None
    min_maf: float = 0.1
    min_ibs_cm: float = 1.0
    min_ibd_cm: float = 1.0
    pbwt: int = 4
    trim: float = 0.5
    discord: float = 0.0005
    out_cm: float = 0.02
    ne: float = 10000.0
    quantile: float = 0.5
    gc_bases: int = 1000
    gc_discord: float = 0.1
    local_segments: int = 10000
    local_max_cdf: float = 0.999
    global_loci: int = 1000
    global_segments: int = 2000
    global_quantile: float = 0.9
    global_multiple: float = 3.0
    min_cdf_ratio: float = 0.001
    max_its: int = 2
    end_morgans: float = 1.0
    fix_focus: bool = False
    prefocus_quantile: float = 0.05
    max_rel_diff: float = 0.1
    out_window_size: int = 500
    seed: int = -99999

    def __post_init__(self) -> None:
        for name, (low, high) in _RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name}={getattr(self, name)} is outside [{low:g}, {high:g}]")

    @property
    def interval(self) -> Interval | None:
        return parse_interval(self.chrom) if self.chrom else None


def parse_arguments(args: list[str]) -> Parameters:
    """``key=value`` words with the documented names (``max-rel-change`` also names ``max-rel-diff``)."""
    kinds = {f.name: f.type for f in fields(Parameters)}
    values: dict[str, object] = {}
    for arg in args:
        key, eq, value = arg.partition("=")
        name = {"max_rel_change": "max_rel_diff"}.get(key.replace("-", "_"), key.replace("-", "_"))
        if name == "nthreads" and value.isdigit() and int(value) > 0:
            continue  # Spark decides how many tasks run at once
        if not eq or not value or name not in kinds or name in values:
            raise ValueError(f"unknown, repeated or empty parameter: {arg!r}")
        if kinds[name] == "bool":
            if value.lower() not in ("true", "t", "false", "f"):
                raise ValueError(f"not true or false: {arg!r}")
            values[name] = value.lower()[0] == "t"
        else:
            values[name] = {"int": int, "float": float}.get(kinds[name], str)(value)
    missing = {"gt", "map", "out"} - values.keys()
    if missing:
        raise ValueError(f"missing: {sorted(missing)}")
    if values["out"] in (values["gt"], values["map"], values.get("excludesamples"), values.get("excludemarkers")):
        raise ValueError("out must differ from the input files")
    return Parameters(**values)  # type: ignore[arg-type]
