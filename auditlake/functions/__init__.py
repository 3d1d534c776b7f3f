"""Scalar expressions over text, paths and severities."""
