"""Readiness ranking of CRM leads and contacts as Spark jobs."""

from callrank.config import EngagementParams, JobConfig, TierThresholds, Weights

__all__ = ["EngagementParams", "JobConfig", "TierThresholds", "Weights"]
