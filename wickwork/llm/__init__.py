"""Operators for preparing large text and vector collections."""
