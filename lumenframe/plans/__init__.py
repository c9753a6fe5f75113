"""Validation plans: rules become findings, findings become scores and reports."""
