"""scrubline: find and redact sensitive text in Spark DataFrames."""

from .plans.scan import ScanConfig, scan, scrub  # noqa: F401
from .operators.policy import Policy, load_policy  # noqa: F401
from .session import build_session, materialize  # noqa: F401

__all__ = ["ScanConfig", "scan", "scrub", "Policy", "load_policy", "build_session", "materialize"]
