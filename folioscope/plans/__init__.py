"""Registered queries: operators applied to the driver tables, and the equivalent SQL."""
