"""All queries over the reference's operators, by name, and their SQL."""

from newsmill.plans import commerce, content, engagement, serving, streams

_MODULES = (engagement, commerce, content, serving, streams)
QUERIES: dict = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES: dict = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
