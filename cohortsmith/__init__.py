"""cohortsmith — synthetic clinical cohorts, data-quality guardrails and retrieval-eval
ground truth, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
