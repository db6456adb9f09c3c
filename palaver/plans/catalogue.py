"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from palaver.plans import boards, ingest, misc, pages, shows, talk, upkeep, words

QUERIES: dict = {**talk.QUERIES, **words.QUERIES, **misc.QUERIES, **ingest.QUERIES, **pages.QUERIES, **shows.QUERIES, **upkeep.QUERIES, **boards.QUERIES}
ORACLES: dict[str, str] = {**talk.ORACLES, **words.ORACLES, **misc.ORACLES, **ingest.ORACLES, **pages.ORACLES, **shows.ORACLES, **upkeep.ORACLES, **boards.ORACLES}
