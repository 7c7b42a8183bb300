"""Every registered query of the harmonization engine, by operator."""

from __future__ import annotations

from concord.plans import q_checks, q_cohort, q_grading_sources, q_rules_constraints, q_values_identity  # noqa: F401
from concord.plans.base import ORACLES, QUERIES  # noqa: F401
