"""Operators for preparing training text: packing, deduplication, decontamination, scans.

Nothing outside this subpackage imports it.
"""
