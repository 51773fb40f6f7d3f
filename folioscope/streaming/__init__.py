"""Jobs as a log of events: idempotent submission, latest state, and the same on streams."""
