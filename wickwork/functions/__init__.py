"""Part of wickwork."""
