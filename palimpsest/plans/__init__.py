"""Logical plans: version resolution and compaction planning."""
