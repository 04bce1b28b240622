"""Operators for preparing text corpora at scale; self-contained, nothing else imports it."""
