"""Registered queries and their SQL."""

from . import candidates, handoff, knowledge, matching, segments

PARTS = [segments, candidates, matching, knowledge, handoff]
