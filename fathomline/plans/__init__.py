"""Chains of operators: builds, searches, expansions, experiments."""
