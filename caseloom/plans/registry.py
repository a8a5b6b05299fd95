"""The modules that register queries of the core."""

from __future__ import annotations

from caseloom.plans import lanes, lists, passages, problems, relations, reports, texts


def modules() -> list:
    return [problems, relations, lists, texts, reports, lanes, passages]
