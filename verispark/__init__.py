"""Claim-verification data engine on Spark: every operator maps tables to tables."""

__version__ = "0.1.0"
