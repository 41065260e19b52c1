"""Cues, paragraphs, ownership and gap filling over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.adapters import PARAGRAPHS_SQL, SEGMENTS_SQL, paragraphs, segments
from catalog.base import query
from cuelake.functions import text as T
from cuelake.operators import joins as J
from cuelake.operators import paragraphs as P

WORDS_SQL = r"""CASE WHEN {h} > 3 * {l} THEN {h} ELSE {h} + {l} END""".format(
    h=r"len(regexp_extract_all(text, '[\x{ac00}-\x{d7a3}]'))",
    l=r"len(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''\x{2019}][A-Za-z0-9]+)*'))",
)


@query("wn05_fill_speaker_gaps", f"""WITH {SEGMENTS_SQL},
f AS (SELECT *, last_value(speaker IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM segments)
SELECT media_id, seq, start_ms, dur_ms, text,
       coalesce(a, first_value(a IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM f""")
def _(t):
    return P.fill_speakers(segments(t))


@query("wn03_break_paragraphs", f"WITH {PARAGRAPHS_SQL} SELECT * FROM paragraphs")
def _(t):
    return paragraphs(t)


@query("ag10_reading_stats", f"""WITH {PARAGRAPHS_SQL}
SELECT speaker, count(*)::BIGINT AS n_paragraphs, sum({WORDS_SQL})::BIGINT AS words,
       sum(dur_ms)::BIGINT AS spoken_ms FROM paragraphs GROUP BY speaker""")
def reading(t):
    return P.reading_stats(paragraphs(t), ["speaker"])


@query("jn01_own_segments", f"""WITH {PARAGRAPHS_SQL}
SELECT s.media_id, s.seq, s.start_ms, s.dur_ms, s.text, s.speaker, p.seq AS owner_seq,
       p.speaker AS owner_speaker
FROM segments s ASOF LEFT JOIN paragraphs p
  ON s.media_id = p.media_id AND s.start_ms >= p.start_ms""")
def _(t):
    return J.own_segments(segments(t), paragraphs(t))


@query("jn03_attach_speakers", f"""WITH {PARAGRAPHS_SQL}
SELECT s.media_id, s.seq, s.start_ms, s.dur_ms, s.text,
  CASE WHEN s.speaker IS NOT NULL AND NOT regexp_matches(s.speaker, '^[A-Za-z]$') THEN s.speaker
       ELSE coalesce((SELECT arg_min(p.speaker, p.seq) FROM paragraphs p
         WHERE p.media_id = s.media_id AND p.start_ms - 50 <= s.start_ms
           AND s.start_ms <= p.start_ms + p.dur_ms + 150), s.speaker) END AS speaker
FROM segments s""")
def _(t):
    return J.attach_speakers(segments(t), paragraphs(t))
