"""caselight: clinical-event analytics and similar-case retrieval on the PySpark DataFrame API."""

__version__ = "0.1.0"
