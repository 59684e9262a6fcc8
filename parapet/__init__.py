"""Screening, redaction, routing, quota replay and audit of prompt/response traffic as Spark jobs."""

from parapet.policy import Policy, PolicyError

__all__ = ["Policy", "PolicyError"]
