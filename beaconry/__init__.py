"""Detection, triage and evaluation of crisis signals in text streams, as PySpark plans."""
