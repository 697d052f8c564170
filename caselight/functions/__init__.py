"""Subpackage of caselight."""
