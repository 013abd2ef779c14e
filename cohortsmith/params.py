"""Typed parameter sets with the defaults of the reproduced behaviour (SRC-07)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import TypeVar

from . import constants as K

P = TypeVar("P", "CohortParams", "GuardrailParams", "EvalParams")
#: Domains of values by field name; fields not named here are free.
_SHARES = {"female_probability", "metformin_if_diabetes", "aspirin_exposure", "drug_x_exposure", "drug_y_exposure",
           "drug_z_exposure", "distribution_tolerance"}
_AT_LEAST = {"batch_size": 1, "min_age": 0, "max_examples": 0, "rank_bucket_width": 1, "max_broadcast_predicates": 0}
_ONE_OF = {"hash": ("md5", "xxhash64"), "scope": ("global", "batch")}


def checked(params: P) -> P:
    """The parameters themselves, or ValueError naming every value outside its domain."""
    bad = []
    for f in fields(params):
        v = getattr(params, f.name)
        if (f.name in _SHARES and not 0 <= v <= 1 or f.name in _AT_LEAST and v < _AT_LEAST[f.name]
                or f.name in _ONE_OF and v not in _ONE_OF[f.name]):
            bad.append(f"{f.name}={v!r}")
    bad += [f"condition_rates[{c!r}]={r!r}" for c, r in getattr(params, "condition_rates", {}).items() if not 0 <= r <= 1]
    if isinstance(params, CohortParams) and params.min_age > params.max_age:
        bad.append(f"min_age={params.min_age!r} above max_age={params.max_age!r}")
    if bad:
        raise ValueError("parameters outside their domain: " + ", ".join(bad))
    return params


def merged(params: P, **given) -> P:
    """SRC-07: the given values over those of ``params``. None keeps what stands; a rate table is
    merged entry by entry. Unknown names and values outside their domain raise ValueError."""
    unknown = sorted(set(given) - {f.name for f in fields(params)})
    if unknown:
        raise ValueError("unknown parameters: " + ", ".join(unknown))
    new = {k: {**getattr(params, k), **v} if isinstance(v, dict) else v for k, v in given.items() if v is not None}
    return checked(replace(params, **new))


@dataclass(frozen=True)
class CohortParams:
    seed: int = 42
    batch_size: int = 1000
    hash: str = "md5"  # or "xxhash64" for large runs without an oracle
    min_age: int = K.MIN_AGE
    max_age: int = K.MAX_AGE
    female_probability: float = K.FEMALE_PROBABILITY
    condition_rates: dict = field(default_factory=lambda: dict(K.CONDITION_RATES))
    metformin_if_diabetes: float = K.METFORMIN_IF_DIABETES
    aspirin_exposure: float = K.ASPIRIN_EXPOSURE
    drug_x_exposure: float = K.DRUG_X_EXPOSURE
    drug_y_exposure: float = K.DRUG_Y_EXPOSURE
    drug_z_exposure: float = K.DRUG_Z_EXPOSURE
    reaction_model: dict = field(default_factory=lambda: {k: dict(v) for k, v in K.REACTION_MODEL.items()})


@dataclass(frozen=True)
class GuardrailParams:
    pii_check_enabled: bool = True
    content_policy_enabled: bool = True
    plausibility_check_enabled: bool = True
    distribution_check_enabled: bool = True
    uniqueness_check_enabled: bool = True
    distribution_tolerance: float = K.DISTRIBUTION_TOLERANCE
    fail_on_error: bool = False
    max_examples: int = K.MAX_EXAMPLES
    # Time of the violations' timestamp (as text); None: the time of the run.
    checked_at: str | None = None
    # "global" checks drift and duplicates over the whole table; "batch" per batch_id.
    scope: str = "global"


@dataclass(frozen=True)
class EvalParams:
    seed: int = 42
    batch_size: int = 1000
    hash: str = "md5"
    include_aggregation_queries: bool = True
    include_multihop_queries: bool = True
    include_negative_controls: bool = True
    # Rows of one ordered group that one window task may rank; larger groups are
    # ranked in id-range buckets of this width (two-level rank, no hot task).
    rank_bucket_width: int = 1 << 20
    # Distinct predicates up to which their table is broadcast; beyond it they are joined.
    max_broadcast_predicates: int = 100_000

    def class_weights(self):
        disabled = set()
        if not self.include_aggregation_queries:
            disabled.add("Aggregation")
        if not self.include_multihop_queries:
            disabled.add("MultiHop")
        if not self.include_negative_controls:
            disabled.add("Negative")
        return [(c, w) for c, w in K.QUERY_CLASS_WEIGHTS if c not in disabled]
