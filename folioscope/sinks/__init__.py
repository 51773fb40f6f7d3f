"""Sinks outside plans: private artifacts by document, and reports of small results."""
