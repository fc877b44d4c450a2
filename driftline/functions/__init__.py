"""Part of driftline."""
