"""Serving bounded results: envelopes, cursors and token budgets on the driver."""
