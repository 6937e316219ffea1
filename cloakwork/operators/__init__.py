"""Relational operators: scan, reconcile, review, mask, grids, page geometry."""
