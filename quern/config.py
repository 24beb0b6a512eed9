"""Validation of run options, and capture of the environment."""

from __future__ import annotations

import math
import platform
import sys
from datetime import datetime, timezone


def utc_now() -> str:
    """ISO-8601 time in UTC; never part of a fingerprint."""
    return datetime.now(timezone.utc).isoformat()


#: Rules by option: (test, what it asks).
POSITIVE = (lambda v: isinstance(v, int) and v >= 1, "a whole number of at least 1")
SHARE = (lambda v: 0 < v < 1, "between 0 and 1")
PROBABILITY = (lambda v: 0 < v <= 1, "above 0 and at most 1")
RULES = {
    "seed": (lambda v: isinstance(v, int) and v >= 0, "a whole number of at least 0"),
    "validation_fraction": SHARE, "test_fraction": SHARE, "target_fraction": SHARE, "overlap_words": POSITIVE, "count": POSITIVE, "per_language": POSITIVE,
    "min_words": POSITIVE, "max_words": POSITIVE, "batch_size": POSITIVE, "dev_cap": POSITIVE, "repeats": POSITIVE, "mask_probability": PROBABILITY,
    "sampling_alpha": PROBABILITY, "max_length": (lambda v: isinstance(v, int) and v >= 8, "a whole number of at least 8"), "window_overlap": (lambda v: isinstance(v, int) and v >= 0, "a whole number of at least 0"),
    "device": (lambda v: v in ("cpu", "cuda"), "cpu or cuda"), "precision": (lambda v: v in ("fp32", "bf16"), "fp32 or bf16"),
}


def validate(options: dict) -> dict:
    """The options, if all are known and within their rules; else a ValueError that names every fault."""
    faults = [f"unknown option {k}" for k in options if k not in RULES and k not in ("languages", "targets", "language_weights")]
    for k, v in options.items():
        if isinstance(v, float) and not math.isfinite(v):
            faults.append(f"{k} must be finite")
        elif k in RULES:
            try:
                ok = v is not None and RULES[k][0](v)
            except TypeError:
                ok = False
            if not ok:
                faults.append(f"{k} must be {RULES[k][1]}")
    for k in ("languages", "targets"):
        if k in options and (not options[k] or len(set(options[k])) != len(options[k])):
            faults.append(f"{k} must be distinct and not empty")
    weights = options.get("language_weights")
    if weights is not None and (not weights or any(not math.isfinite(w) or w <= 0 for w in weights.values())):
        faults.append("language_weights must be finite and positive")
    if weights and set(options.get("targets", ())) - set(weights):
        faults.append("every target needs a weight")
    if options.get("device") == "cpu" and options.get("precision", "fp32") != "fp32":
        faults.append("cpu needs fp32")
    if "min_words" in options and "max_words" in options and not faults and options["min_words"] > options["max_words"]:
        faults.append("min_words exceeds max_words")
    if "window_overlap" in options and "max_length" in options and not faults and options["window_overlap"] >= options["max_length"] - 2:
        faults.append("window_overlap must leave room in a window")
    if faults:
        raise ValueError("; ".join(faults))
    return options


def environment(spark=None) -> dict:
    """Versions and platform of a run."""
    import pyspark

    out = {"python": sys.version.split()[0], "platform": platform.platform(), "pyspark": pyspark.__version__, "time": utc_now()}
    if spark is not None:
        out["spark"] = spark.version
        out["cores"] = spark.sparkContext.defaultParallelism
    return out
