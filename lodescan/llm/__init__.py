"""Operators for preparing training data from scanned text and findings."""
