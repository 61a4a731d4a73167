"""Batch plans: bronze shapes, silver star, gold marts, measures, reports, lookups and live figures."""
