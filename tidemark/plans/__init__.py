"""Registered queries, each with its DuckDB equivalent where SQL can express it."""

from tidemark.plans import budgets, clips, cuts, decisions, events, knowledge, materials, observations, pictures, ranges, signals, syncs, takes, texts, trims, validations
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "budgets", "clips", "cuts", "decisions", "events", "knowledge", "materials", "observations", "pictures", "ranges", "signals", "syncs", "takes", "texts", "trims", "validations"]
