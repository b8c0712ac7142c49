"""All queries of the library and the SQL they are held against."""

from __future__ import annotations

from turnwise.functions import scalars
from turnwise.operators import alignment, audio, blocks, candidates, chunks, documents, exports, identity, intervals, local_scan, metrics, names, results, sequential, settings, structure, validation
from turnwise.plans.query import with_views
from turnwise.streaming import streams

_FAMILIES = (intervals, structure, metrics, blocks, chunks, scalars, identity)
#: Queries that aren't SQL: the function, and its SQL for DuckDB where there is one.
_OWN = {
    "speaker_assign_overlap": (intervals.speaker_assign_overlap, intervals.SPEAKER_ASSIGN_ORACLE),
    "word_speaker_align": (intervals.word_speaker_align, intervals.WORD_ALIGN_ORACLE),
    "segment_fallback_align": (intervals.segment_fallback_align, intervals.FALLBACK_ORACLE),
    "reading_blocks": (blocks.reading_blocks_query, blocks.BLOCKS_ORACLE),
    **sequential.OWN,
    **identity.OWN,
    **exports.OWN,
    **validation.OWN,
    **intervals.OWN,
    **scalars.OWN,
    **local_scan.OWN,
    **chunks.OWN,
    **streams.OWN,
    **results.OWN,
    **candidates.OWN,
    **documents.OWN,
    **names.OWN,
    **alignment.OWN,
    **audio.OWN,
    **blocks.OWN,
    **settings.OWN,
    "light_identity": (identity.light_identity_query, candidates.LIGHT_ORACLE),
}


def flagship(spark, sf_dir):
    """Reading blocks of transcripts whose segments take their speaker from the turns they overlap most."""
    from turnwise.sources import views

    ids = ["source_id", "seg_id"]
    speakers = intervals.assign_speakers(views.segments(spark, sf_dir).select(*ids, "start_ms", "end_ms"), views.turns(spark, sf_dir), ids).select(*ids, "speaker")
    return blocks.reading_blocks(views.segments(spark, sf_dir).join(speakers, ids), speaker="speaker")


def queries() -> dict:
    found = {k: f for k, (f, _) in _OWN.items()}
    for family in _FAMILIES:
        found |= family.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found = {k: with_views(text) for k, (_, text) in _OWN.items() if text}
    for family in _FAMILIES:
        found |= {k: q.oracle() for k, q in family.QUERIES.items()}
    return found
