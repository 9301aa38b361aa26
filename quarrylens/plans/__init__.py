"""Registered queries: importing this package fills the registry."""

from quarrylens.plans import context, formats, live, reads, reports, rules, search, semantic, stored  # noqa: F401
