"""Readers and writers of records, signals, golden sets and predictions."""
