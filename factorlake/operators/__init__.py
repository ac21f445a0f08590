"""Operators over panels: grids, joins in time, universes, labels, models, metrics, portfolios, audits."""
