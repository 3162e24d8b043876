"""Workflows and whole pipelines built from the operators."""
