"""Compositions: the store KPI table, the views on it, the rules, the whole run."""
