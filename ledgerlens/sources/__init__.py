"""Readers, derived business views, audit logs and report writers."""
