"""Registered queries over the test tables and their independent SQL oracles."""
