"""Run planning on small tables: which files to scan and at which rate, and what a further round must add."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from corpusloom.plans.config import Pipeline, digest


@dataclass(frozen=True)
class FileInfo:
    path: str
    source: str
    rows: int


def stable_order(seed: int, value: str) -> int:
    return int(hashlib.sha256(f"{seed}:file:{value}".encode()).hexdigest()[:15], 16)


def plan(p: Pipeline, calibration: dict[tuple[str, str], dict], files: list[FileInfo], used: frozenset[str] = frozenset(), deficits: dict[tuple[str, str], int] | None = None) -> dict:
    """{files, rates, shortfalls, passed, sha256}.

    ``calibration`` maps (source, bucket) to doc_rate and tokens_per_doc. A source is scanned for the bucket that
    needs most of it: target tokens times oversampling over the tokens its rows yield. Files come in hash order until
    they suffice; the sampling rate of a bucket is its need over what the chosen files yield, at most 1. A further
    round passes the ``deficits`` of the last one and its ``used`` files; without a deficit it is an error.
    """
    wanted: dict[tuple[str, str], float] = {}
    for b in p.buckets:
        for s, w in b.weights.items():
            need = b.target_tokens * w if deficits is None else deficits.get((b.name, s), 0)
            if need > 0:
                wanted[s, b.name] = need * p.oversample
    if not wanted:
        raise ValueError("nothing is short")
    chosen, rates, short = [], {}, []
    for s in sorted({s for s, _ in wanted}):
        need_rows = 0.0
        for (src, b), need in wanted.items():
            c = calibration.get((src, b))
            if src == s and c and c["doc_rate"] * c["tokens_per_doc"] > 0:
                need_rows = max(need_rows, need / (c["doc_rate"] * c["tokens_per_doc"]))
        rows = 0
        for f in sorted((f for f in files if f.source == s and f.path not in used), key=lambda f: (stable_order(p.seed, f.path), f.path)):
            if rows >= need_rows:
                break
            chosen.append(f.path)
            rows += f.rows
        for (src, b), need in wanted.items():
            if src == s:
                c = calibration.get((s, b), {"doc_rate": 0, "tokens_per_doc": 0})
                got = rows * c["doc_rate"] * c["tokens_per_doc"]
                rates[f"{b}/{s}"] = min(1.0, need / got) if got else 0.0
                if got < need:
                    short.append({"source": s, "bucket": b, "missing_tokens": round(need - got)})
    out = {"files": sorted(chosen), "rates": rates, "shortfalls": short, "passed": not short}
    return out | {"sha256": digest(out)}


def evenly_spaced(files: list[str], n: int) -> list[str]:
    """At most ``n`` files spread over a sorted list, the first and last among them."""
    if len(files) <= n:
        return files
    return [files[0]] if n == 1 else [files[round(i * (len(files) - 1) / (n - 1))] for i in range(n)]


def quota_targets(total: int, shares: dict[str, float], available: dict[str, int]) -> dict[str, int]:
    """Whole targets per key: shares of the largest total up to ``total`` that every key can meet, remainders to the largest fractions."""
    size = min([total, *(int(available.get(k, 0) / s) for k, s in shares.items() if s > 0)])
    exact = {k: size * s for k, s in shares.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], k))[: size - sum(out.values())]:
        out[k] += 1
    return out
