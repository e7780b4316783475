"""Native Catalyst column expressions (no Python UDFs)."""
