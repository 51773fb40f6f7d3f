"""Adapters to renderers, recognisers and models: contracts, and stubs that fail closed."""
