"""Scalar functions on columns; all native."""
