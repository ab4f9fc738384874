"""Composed plans: document analysis, corpus insights, reports."""
