"""All queries over the driver's tables; importing a module registers its queries."""

from . import alignment, cue_edits, editing, edits, evidence, files, lookups, more, quality, queries, relations, revisions, scalars, segmentation, streams, transcripts, wires, words, writing
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "alignment", "cue_edits", "editing", "edits", "evidence", "files", "lookups", "more", "quality", "queries", "relations", "revisions", "scalars", "segmentation", "streams", "transcripts", "wires", "words", "writing"]
