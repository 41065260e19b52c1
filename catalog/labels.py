"""Speakers, summaries, tracks and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.adapters import PARAGRAPHS_SQL, SEGMENTS_SQL, paragraphs, segments
from catalog.base import query
from catalog.texts import SCORE_SQL
from cuelake.functions import clock as K
from cuelake.functions import text as T
from cuelake.operators import joins as J
from cuelake.operators import search as Q
from cuelake.operators import speakers as P
from cuelake.operators import summary as U
from cuelake.operators import tracks as R
from cuelake.operators.paragraphs import extent, spoken
from cuelake.plans.clean import mark_share

# -- speakers ----------------------------------------------------------------------------


def names(t, *who):
    return t.conversations.select(F.col("conv_id").alias("media_id")).distinct().withColumn(
        "names", F.array(*[F.lit(w) for w in who])
    )


def turns(t):
    """Two turns for each paragraph that starts on an even second; the later one wins."""
    p = paragraphs(t).where(F.floor(F.col("start_ms") / 1000) % 2 == 0)
    row = lambda n, who: F.struct(F.lit(n).alias("pos"), F.lit(who).alias("speaker"))
    return p.select("media_id", F.col("seq").alias("i"), F.explode(F.array(row(0, "A"), row(1, "speaker 2"))).alias("x")).select(
        "media_id", "i", "x.pos", "x.speaker"
    )


@query("jn04_apply_turns", f"""WITH {PARAGRAPHS_SQL}, o AS (SELECT *, CASE WHEN start_ms // 1000 % 2 = 0 THEN 'Ben' WHEN speaker = 'user' THEN NULL ELSE speaker END AS own
  FROM (SELECT media_id, seq, start_ms, dur_ms, text, CASE WHEN speaker = 'user' THEN NULL ELSE speaker END AS speaker FROM paragraphs))
SELECT media_id, seq, start_ms, dur_ms, text, last_value(own IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker FROM o""")
def _(t):
    p = paragraphs(t).withColumn("speaker", F.when(F.col("speaker") != "user", F.col("speaker")))
    return P.apply_turns(P.with_names(p, names(t, "Ana", "Ben")), turns(t))


def questions(t):
    asks = F.when(F.col("dur_ms") < 3000, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return paragraphs(t).withColumns({"text": asks, "speaker": F.when(F.col("speaker") == "system", F.col("speaker"))})


_SIZE = f"length(regexp_replace(text, '[{S.SP}]+', '', 'g'))"


_ROLES_SQL = f"""q AS (SELECT media_id, seq, start_ms, dur_ms, CASE WHEN dur_ms < 3000 THEN text || '?' ELSE text END AS text, CASE WHEN speaker = 'system' THEN speaker END AS sp FROM paragraphs),
f AS (SELECT media_id, seq, sp, {S.question('text')} AS asks, {_SIZE} > 24 AS lng, {_SIZE} < 14 AS brief FROM q),
r AS (SELECT media_id, seq, CASE WHEN sp IS NOT NULL THEN sp WHEN asks THEN 'Ana' WHEN lng THEN 'Ben' ELSE 'Ana' END AS role FROM f WHERE seq = 0
  UNION ALL SELECT f.media_id, f.seq, CASE WHEN f.sp IS NOT NULL THEN f.sp WHEN f.asks THEN 'Ana' WHEN f.lng AND r.role = 'Ana' THEN 'Ben'
    WHEN f.brief AND r.role = 'Ben' THEN 'Ana' ELSE r.role END FROM r JOIN f ON f.media_id = r.media_id AND f.seq = r.seq + 1)"""


@query("wn06_label_interview", f"WITH RECURSIVE {PARAGRAPHS_SQL}, {_ROLES_SQL} SELECT media_id, seq, role AS speaker FROM r")
def _(t):
    return P.label_interview(P.with_names(questions(t), names(t, "Ana", "Ben"))).select("media_id", "seq", "speaker")


@query("finish_job_labels", f"""WITH RECURSIVE {PARAGRAPHS_SQL}, {_ROLES_SQL},
kd AS (SELECT conv_id AS media_id, role <> 'system' AS talk FROM conversations WHERE turn = 0),
ht AS (SELECT DISTINCT media_id FROM paragraphs WHERE media_id % 2 = 0 AND start_ms // 1000 % 2 = 0),
tu AS (SELECT media_id, seq, last_value(CASE WHEN start_ms // 1000 % 2 = 0 THEN 'Ben' ELSE sp END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS told FROM q),
o AS (SELECT q.media_id, q.seq, q.start_ms, q.dur_ms, CASE WHEN NOT kd.talk THEN q.sp WHEN ht.media_id IS NOT NULL THEN tu.told ELSE r.role END AS speaker
  FROM q JOIN kd USING (media_id) LEFT JOIN ht USING (media_id) JOIN tu USING (media_id, seq) JOIN r USING (media_id, seq))
SELECT s.media_id, s.seq, s.start_ms, s.dur_ms, s.text, CASE WHEN s.speaker IS NOT NULL AND NOT regexp_matches(s.speaker, '^[A-Za-z]$') THEN s.speaker
  ELSE coalesce((SELECT arg_min(o.speaker, o.seq) FROM o WHERE o.speaker IS NOT NULL AND o.media_id = s.media_id AND o.start_ms - 50 <= s.start_ms AND s.start_ms <= o.start_ms + o.dur_ms + 150), s.speaker) END AS speaker FROM segments s""")
def _(t):
    kinds = t.conversations.where(F.col("turn") == 0).select(
        F.col("conv_id").alias("media_id"), F.when(F.col("role") == "system", "general").otherwise("interview").alias("kind"),
        F.lit("- Ana: hello\n- Ben: hi").alias("summary"), F.array().cast("array<string>").alias("speakers"))
    return P.finish_labels(segments(t), questions(t), kinds, turns(t).where(F.col("media_id") % 2 == 0))[0]


@query("ag07_speaker_names", f"""WITH {PARAGRAPHS_SQL}, a AS (SELECT media_id, speaker, 0 AS side, seq FROM paragraphs WHERE speaker IS NOT NULL
  UNION ALL SELECT media_id, speaker, 1, seq FROM segments WHERE speaker IS NOT NULL),
m AS (SELECT media_id, speaker, min(side * 1000000000 + seq) AS at FROM a GROUP BY ALL)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY "at") - 1)::BIGINT AS pos, speaker FROM m""".replace(" AS at FROM", ' AS "at" FROM'))
def _(t):
    return P.speaker_names(paragraphs(t), segments(t))


@query("ag08_mark_share", """SELECT conv_id AS media_id, round(avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END), 6) AS share,
  avg(CASE WHEN role = 'user' THEN 1.0 ELSE 0.0 END) >= 0.35 AS decoration FROM conversations GROUP BY 1""")
def _(t):
    marked = F.when(F.col("role") == "user", F.concat(F.lit(" >> "), "text")).otherwise(F.col("text"))
    cues = t.conversations.select(F.col("conv_id").alias("media_id"), marked.alias("text"))
    return mark_share(cues).withColumn("share", F.round("share", 6))


EDIT_SQL = PARAGRAPHS_SQL + """,
ed AS (SELECT media_id, seq, CASE WHEN speaker = 'assistant' THEN 'Edited ' || seq WHEN dur_ms < 2000 THEN '' END AS e_text, 'Ana' AS e_speaker, NOT (speaker = 'assistant' AND seq % 2 = 0) AS e_set
  FROM paragraphs WHERE speaker = 'assistant' OR dur_ms < 2000 OR speaker = 'system')"""


def edits(t):
    p = paragraphs(t)
    return p.where((F.col("speaker") == "assistant") | (F.col("dur_ms") < 2000) | (F.col("speaker") == "system")).select(
        "media_id", "seq",
        F.when(F.col("speaker") == "assistant", F.concat(F.lit("Edited "), "seq")).when(F.col("dur_ms") < 2000, "").alias("text"),
        F.lit(" Ana ").alias("speaker"), "start_ms", (~((F.col("speaker") == "assistant") & (F.col("seq") % 2 == 0))).alias("set_speaker"),
    )


@query("so08_update_paragraphs", f"""WITH {EDIT_SQL},
own AS (SELECT s.*, p.seq AS o, p.start_ms + greatest(p.dur_ms, 400) AS o_end FROM segments s ASOF LEFT JOIN paragraphs p ON s.media_id = p.media_id AND s.start_ms >= p.start_ms),
k AS (SELECT own.media_id, own.start_ms, own.dur_ms, own.text, CASE WHEN e.media_id IS NOT NULL AND e.e_text IS NULL THEN 'Ana' ELSE own.speaker END AS speaker, 1 AS side, own.seq AS o
  FROM own LEFT JOIN ed e ON e.media_id = own.media_id AND e.seq = own.o WHERE NOT coalesce(e.e_text IS NOT NULL AND own.start_ms < own.o_end, false)),
n AS (SELECT p.media_id, p.start_ms, p.dur_ms, e.e_text, CASE WHEN e.e_set THEN 'Ana' ELSE p.speaker END, 0, p.seq FROM paragraphs p JOIN ed e USING (media_id, seq) WHERE e.e_text <> ''),
a AS (SELECT * FROM k UNION ALL SELECT * FROM n)
SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, side, o) - 1)::BIGINT AS seq, start_ms, dur_ms, text, speaker FROM a""")
def _(t):
    return P.update_paragraphs(segments(t), paragraphs(t), edits(t))[0]


@query("so08_edited_paragraphs", f"""WITH {EDIT_SQL} SELECT p.media_id, p.seq, p.start_ms, p.dur_ms, coalesce(e.e_text, p.text) AS text,
  CASE WHEN e.e_set THEN 'Ana' ELSE p.speaker END AS speaker FROM paragraphs p LEFT JOIN ed e USING (media_id, seq)""")
def _(t):
    return P.update_paragraphs(segments(t), paragraphs(t), edits(t))[1]


@query("so08_edit_records", f"""WITH {EDIT_SQL} SELECT p.media_id, p.start_ms, coalesce(e.e_text, p.text) AS text, CASE WHEN e.e_set THEN 'Ana' ELSE p.speaker END AS speaker
FROM paragraphs p JOIN ed e USING (media_id, seq) WHERE coalesce(e.e_text, p.text) <> p.text OR e.e_set""")
def _(t):
    return P.update_paragraphs(segments(t), paragraphs(t), edits(t))[2]


@query("jn08_overlay_edits", f"""WITH {EDIT_SQL} SELECT p.media_id, p.seq, p.start_ms, p.dur_ms,
  CASE WHEN e.media_id IS NOT NULL THEN e.e_text ELSE p.text END AS text, CASE WHEN e.media_id IS NOT NULL THEN ' Ana ' ELSE p.speaker END AS speaker
FROM paragraphs p LEFT JOIN ed e USING (media_id, seq)""")
def _(t):
    return J.overlay_edits(paragraphs(t), edits(t).drop("seq")).select("media_id", "seq", "start_ms", "dur_ms", "text", "speaker")


def renames(t):
    """Two rows per name of which the later one counts, and a name renamed to itself."""
    names = t.conversations.select(F.col("role").alias("old")).distinct()
    new = F.when(F.col("old") == "assistant", "assistant").when(F.col("old") == "user", " Ana ").otherwise(" ")
    return names.select("old", new.alias("new"), F.lit(2).alias("ord")).unionByName(names.select("old", F.lit("Bob").alias("new"), F.lit(1).alias("ord")))


@query("so09_rename_speakers", f"""WITH {PARAGRAPHS_SQL},
own AS (SELECT s.*, coalesce(p.speaker, s.speaker) AS label FROM segments s ASOF LEFT JOIN paragraphs p ON s.media_id = p.media_id AND s.start_ms >= p.start_ms)
SELECT media_id, seq, start_ms, dur_ms, text, CASE label WHEN 'user' THEN 'Ana' WHEN 'system' THEN NULL ELSE speaker END AS speaker FROM own""")
def _(t):
    return P.rename_speakers(segments(t), paragraphs(t), renames(t))[0]


@query("so09_rename_records", f"""WITH {PARAGRAPHS_SQL} SELECT media_id, start_ms, text, CASE speaker WHEN 'user' THEN 'Ana' END AS speaker FROM paragraphs WHERE speaker IN ('user', 'system')""")
def _(t):
    return P.rename_speakers(segments(t), paragraphs(t), renames(t))[2]


# -- summaries ---------------------------------------------------------------------------


@query("prj02_summary_input", f"""WITH {PARAGRAPHS_SQL} SELECT media_id, seq, left(text, 800) AS text, left(nullif(speaker, ''), 40) AS speaker FROM paragraphs WHERE seq < 800""")
def _(t):
    return U.summary_input(paragraphs(t))


_LINE = "concat(CASE WHEN speaker IS NOT NULL THEN speaker || ': ' ELSE '' END, text)"
LONG_SQL = f"""long AS (SELECT doc_id % 5 AS media_id, doc_id // 5 AS seq, text, source AS speaker FROM documents),
ln AS (SELECT media_id, seq, {_LINE} AS line FROM long)"""


def long_paragraphs(t):
    """Five long recordings whose paragraphs are whole documents."""
    return t.documents.select(
        (F.col("doc_id") % 5).alias("media_id"), F.floor(F.col("doc_id") / 5).cast("bigint").alias("seq"), "text",
        F.col("source").alias("speaker"),
    )


@query("wn12_body_prefix", f"""WITH {LONG_SQL} SELECT media_id, seq, line FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY media_id ORDER BY seq) AS used FROM ln) WHERE used <= 40000""")
def _(t):
    return U.body_prefix(long_paragraphs(t))


PACK_SQL = LONG_SQL + """,
pk AS (SELECT media_id, seq, 0::BIGINT AS pack, length(line) + 1 AS used FROM ln WHERE seq = 0
  UNION ALL SELECT l.media_id, l.seq, CASE WHEN p.used + length(l.line) > 7000 THEN p.pack + 1 ELSE p.pack END,
    CASE WHEN p.used + length(l.line) > 7000 THEN 0 ELSE p.used END + length(l.line) + 1 FROM pk p JOIN ln l ON l.media_id = p.media_id AND l.seq = p.seq + 1),
pt AS (SELECT p.media_id, p.pack, string_agg(l.line, chr(10) ORDER BY l.seq) AS text FROM pk p JOIN ln l USING (media_id, seq) GROUP BY ALL)"""


@query("wn13_pack_lines", f"WITH RECURSIVE {PACK_SQL} SELECT * FROM pt")
def _(t):
    return U.pack_lines(long_paragraphs(t))


@query("tk07_sample_packs", f"""WITH RECURSIVE {PACK_SQL}, n AS (SELECT media_id, max(pack) + 1 AS n FROM pt GROUP BY 1),
w AS (SELECT media_id, unnest(CASE WHEN n > 5 THEN [0, n - 1, greatest(0, floor(1 * (n - 2) / 4.0 - 0.5))::BIGINT + 1, greatest(0, floor(2 * (n - 2) / 4.0 - 0.5))::BIGINT + 1,
   least(n - 3, greatest(0, floor(3 * (n - 2) / 4.0 - 0.5)))::BIGINT + 1] ELSE range(0, n) END) AS pack FROM n)
SELECT DISTINCT pt.* FROM pt JOIN w USING (media_id, pack)""")
def _(t):
    return U.sample_packs(U.pack_lines(long_paragraphs(t)))


def doc_paragraphs(t):
    return t.documents.select(
        F.col("doc_id").alias("media_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text")
    ).select("media_id", F.col("seq").cast("bigint").alias("seq"), "text")


def doc_jobs(t):
    return t.documents.select(F.col("doc_id").alias("media_id"), F.col("source").alias("title"), F.lit("podcast").alias("kind"))


_SENTENCE_CUT = f"regexp_replace(regexp_replace({S.strip_noise('text')}, '([{T.SENTENCE_MARKS}])[{S.SP}]+', '\\1' || chr(1), 'g'), '((?:니다|까요|세요|죠))[{S.SP}]+', '\\1' || chr(1), 'g')"
SUMMARY_SQL = f"""lines AS (SELECT doc_id, title, i - 1 AS seq, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM
  (SELECT doc_id, source AS title, string_split(text, chr(10)) AS l FROM documents))),
cut AS (SELECT doc_id, seq, list_filter(list_transform(string_split(x, chr(1)), lambda s: {S.trim('s')}), lambda s: length(s) >= 10) AS parts FROM (SELECT doc_id, seq, {_SENTENCE_CUT} AS x FROM lines)),
said AS (SELECT *, NOT {S.boilerplate('s')} AS usable FROM (SELECT doc_id, seq, i, parts[i] AS s FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut))),
tally AS (SELECT doc_id, count(*) FILTER (usable) AS n_usable, count(*) AS n_all FROM said GROUP BY 1),
pool AS (SELECT doc_id, s, CASE WHEN n_usable = 0 THEN n_all ELSE n_usable END AS total, row_number() OVER (PARTITION BY doc_id ORDER BY seq, i) - 1 AS idx
  FROM said JOIN tally USING (doc_id) WHERE usable OR n_usable = 0),
scored AS (SELECT *, {SCORE_SQL} AS score FROM (SELECT *, CASE WHEN total <= 1 THEN 0.5::DOUBLE ELSE idx::DOUBLE / (total - 1) END AS pos FROM pool)),
thirds AS (SELECT * FROM scored CROSS JOIN range(3) AS k(third) WHERE idx >= total * third // 3 AND idx < greatest(total * third // 3 + 1, total * (third + 1) // 3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, third ORDER BY score DESC, idx) AS r FROM thirds),
points AS (SELECT doc_id, list(point ORDER BY third, r) AS points FROM (SELECT doc_id, third, r, {S.shorten('s')} AS point FROM ranked WHERE r <= 3) GROUP BY 1),
kept AS (SELECT doc_id, points, 0 AS i, []::VARCHAR[] AS acc FROM points
  UNION ALL SELECT doc_id, points, i + 1, CASE WHEN points[i + 1] = '' OR len(list_filter(acc, lambda a: contains(a, left(points[i + 1], 24)))) > 0 THEN acc ELSE list_append(acc, points[i + 1]) END
  FROM kept WHERE i < len(points)),
firsts AS (SELECT doc_id, {S.shorten('s', 120)} AS line FROM pool WHERE idx = 0),
summaries AS (SELECT d.doc_id AS media_id, CASE WHEN k.doc_id IS NULL THEN 'No usable caption text to summarize for “' || coalesce(nullif(d.source, ''), 'this video') || '”.'
  WHEN len(k.acc) = 0 THEN '- ' || f.line ELSE '{T.KEY_POINT_LABELS["podcast"]} key points:' || chr(10) || array_to_string(list_transform(k.acc[1:10], lambda p: '- ' || p), chr(10)) END AS summary
  FROM documents d LEFT JOIN (SELECT * FROM kept WHERE i = len(points)) k USING (doc_id) LEFT JOIN firsts f USING (doc_id))"""


@query("tk02_extractive_summary", f"WITH RECURSIVE {SUMMARY_SQL} SELECT media_id, summary FROM summaries")
def _(t):
    return U.summarize(doc_jobs(t), doc_paragraphs(t))


def dump_sql(summaries):
    """WITH parts and the flag of summaries(doc_id, l, s): the lines of a text and its summary."""
    return f"""e AS (SELECT doc_id, {S.trim('s')} AS s, regexp_replace(array_to_string(l[1:6], ' '), '[{S.SP}]+', ' ', 'g') AS o FROM {summaries}),
f AS (SELECT *, {S.squash("regexp_replace(s, '(?m)^[-*•][" + S.SP + "]*', '', 'g')")} AS c, list_filter(list_transform(regexp_split_to_array(s, '\\n'), lambda x: {S.trim('x')}), lambda x: x <> '') AS k FROM e),
g AS (SELECT doc_id, (s = '' OR regexp_matches(s, '(?i)auto-extracted') OR (length(c) >= 80 AND contains(o, left(c, 72))) OR
  (len(list_filter(k, lambda x: length(x) > 180)) >= 2 AND len(k) <= 4)) AS dump FROM f)"""


@query("summarize_corpus_flags", f"""WITH RECURSIVE {SUMMARY_SQL}, d AS (SELECT doc_id, regexp_split_to_array(text, '\\n') AS l, summary AS s FROM documents JOIN summaries ON media_id = doc_id),
{dump_sql('d')} SELECT media_id, summary, dump FROM summaries JOIN g ON doc_id = media_id""")
def _(t):
    return U.transcript_dumps(U.summarize(doc_jobs(t), doc_paragraphs(t)), doc_paragraphs(t))


@query("flt12_transcript_dumps", f"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '\\n') AS l, CASE lang WHEN 'en' THEN text WHEN 'de' THEN '' WHEN 'fr' THEN 'Auto-Extracted' ELSE source END AS s FROM documents),
{dump_sql('d')} SELECT doc_id AS media_id, dump FROM g""")
def _(t):
    s = F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", "").when(F.col("lang") == "fr", "Auto-Extracted").otherwise(F.col("source"))
    return U.transcript_dumps(t.documents.select(F.col("doc_id").alias("media_id"), s.alias("summary")), doc_paragraphs(t)).select("media_id", "dump")


@query("tk08_opening_sample", f"""WITH {PARAGRAPHS_SQL} SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS sample FROM paragraphs WHERE seq < 12 GROUP BY 1""")
def _(t):
    return U.opening_sample(paragraphs(t))


# -- tracks ------------------------------------------------------------------------------

TRACK_SQL = """tr AS (SELECT doc_id // 5 AS media_id, (doc_id % 5)::INT AS pos, CASE WHEN source = 'src7' THEN lang || '-XX' ELSE lang END AS language_code,
  CASE WHEN (doc_id // 5 + doc_id) % 2 = 0 THEN 'manual' ELSE 'asr' END AS source_type, (doc_id // 5 + doc_id) % 2 <> 0 AS is_auto FROM documents)"""


def tracks(t):
    m = F.floor(F.col("doc_id") / 5)
    manual = (m + F.col("doc_id")) % 2 == 0
    return t.documents.select(
        m.cast("bigint").alias("media_id"), (F.col("doc_id") % 5).cast("int").alias("pos"),
        F.when(F.col("source") == "src7", F.concat("lang", F.lit("-XX"))).otherwise(F.col("lang")).alias("language_code"),
        F.when(manual, "manual").otherwise("asr").alias("source_type"), (~manual).alias("is_auto"),
    )


_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN {S.lang_matches('language_code', "'de'")} THEN 0 WHEN {S.lang_matches('language_code', "'en'")} THEN 2 ELSE 4 END
  + CASE source_type WHEN 'manual' THEN 0 ELSE 1 END, pos) AS r FROM tr"""


@query("tk01_pick_track", f"WITH {TRACK_SQL} SELECT media_id, pos, language_code, source_type, is_auto FROM ({_RANKED}) WHERE r = 1")
def _(t):
    return R.pick_track(tracks(t), "auto", ("de", "en"))


@query("jn14_concrete_track", f"""WITH {TRACK_SQL}, c AS (SELECT media_id, language_code AS want, source_type AS kind FROM ({_RANKED}) WHERE r = 1),
x AS (SELECT tr.*, row_number() OVER (PARTITION BY media_id ORDER BY pos) AS r FROM tr JOIN c USING (media_id) WHERE source_type = kind AND {S.lang_matches('language_code', 'want')})
SELECT media_id, pos, language_code, source_type, is_auto FROM x WHERE r = 1""")
def _(t):
    return R.pick_concrete(tracks(t), R.pick_track(tracks(t), "auto", ("de", "en")))


@query("flt09_language_matches", f"WITH {TRACK_SQL} SELECT media_id, pos, {S.lang_matches('language_code', chr(39) + 'EN' + chr(39))} AS english FROM tr")
def _(t):
    return tracks(t).select("media_id", "pos", T.lang_matches(F.col("language_code"), F.lit("EN")).alias("english"))


@query("flt10_language_missing", f"""WITH {TRACK_SQL}, g AS (SELECT DISTINCT media_id FROM tr WHERE {S.lang_matches('language_code', "'en'")}),
m AS (SELECT * FROM tr WHERE media_id NOT IN (SELECT media_id FROM g)), n AS (SELECT media_id, language_code || CASE WHEN is_auto THEN ' (auto)' ELSE '' END AS name, min(pos) AS pos FROM m GROUP BY ALL),
l AS (SELECT media_id, string_agg(name, ', ' ORDER BY pos) AS available FROM n GROUP BY 1),
f AS (SELECT media_id, language_code AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY CASE source_type WHEN 'manual' THEN 0 ELSE 1 END, pos) AS r FROM m) WHERE r = 1)
SELECT media_id, available, fallback, 'language_missing' AS code FROM l JOIN f USING (media_id)""")
def _(t):
    return R.language_missing(tracks(t), "en")


@query("flt10_playability", """SELECT event_id, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'age_restricted' WHEN 'error' THEN 'unavailable' WHEN 'signup' THEN 'members_only'
  WHEN 'purchase' THEN 'unavailable' END AS code FROM events""")
def _(t):
    e = F.col("event_type")
    status = F.when(e == "error", "error").when(e == "purchase", "LOGIN_REQUIRED").when(e == "click", "LOGIN_REQUIRED")
    reason = F.when(e == "click", "Confirm your Age").when(e == "signup", "Join this channel").when(e == "purchase", "This is Private")
    return t.events.select("event_id", R.playability_class(status, reason).alias("code"))


@query("flt11_provider_status", """WITH s AS (SELECT event_id, [200, 401, 404, 413, 429, 500][event_id % 6 + 1] AS st, event_type, value FROM events)
SELECT event_id, CASE WHEN st = 401 THEN 'provider_auth_failed' WHEN st = 429 THEN 'provider_rate_limited' WHEN st = 413 THEN 'chunk_too_large' ELSE 'transcription_failed' END AS speech,
  st IN (429, 500) AS again, CASE WHEN event_type = 'error' THEN 'quota_exhausted' WHEN st = 429 THEN 'rate_limited' WHEN st = 404 THEN 'model_unavailable' ELSE 'provider_rejected' END AS slide,
  least(30.0, greatest(1.0, CASE WHEN value = 0 THEN 2 ELSE value END))::DOUBLE AS wait, CASE WHEN st IN (401, 404, 429) THEN 'none' ELSE 'unknown' END AS billing FROM s""")
def _(t):
    st = F.element_at(F.array(*[F.lit(x) for x in (200, 401, 404, 413, 429, 500)]), (F.col("event_id") % 6 + 1).cast("int"))
    code = F.when(F.col("event_type") == "error", "insufficient_quota")
    a, b = R.transcription_failure(st), R.extraction_failure(st, code, F.col("value").cast("string"))
    return t.events.select("event_id", a["code"].alias("speech"), a["retryable"].alias("again"), b["code"].alias("slide"), b["retry_after"].alias("wait"), b["billing"].alias("billing"))


@query("flt19_hard_failures", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1")
def _(t):
    code = F.when(F.col("event_type") == "error", "unavailable").when(F.col("event_type") == "signup", "members_only").otherwise("network")
    return t.events.where(code.isin(R.HARD_FAILURES)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("tk09_resolve_captures", """WITH c AS (SELECT doc_id // 4 AS media_id, (doc_id % 4) // 2 + 1 AS provider, doc_id % 2 AS attempt, lang = 'en' OR lang = 'de' AS ok, lang,
   CASE lang WHEN 'fr' THEN 'no_captions' WHEN 'es' THEN 'unavailable' END AS err FROM documents),
p AS (SELECT media_id, provider, min(CASE WHEN ok AND lang = 'en' THEN attempt END) AS good, min(CASE WHEN lang = 'es' THEN attempt END) AS hard, arg_max(lang, attempt) AS last FROM c GROUP BY ALL),
q AS (SELECT *, good IS NOT NULL AND (hard IS NULL OR good < hard) AS works, CASE WHEN hard IS NOT NULL THEN 'unavailable' WHEN last IN ('en', 'de') THEN 'language_missing' ELSE 'no_captions' END AS e FROM p),
r AS (SELECT media_id, min(CASE WHEN works THEN provider * 10 + good END) AS w, max(CASE WHEN provider = 1 AND NOT works THEN e END) AS f, max(CASE WHEN provider = 2 AND NOT works THEN e END) AS s FROM q GROUP BY 1)
SELECT media_id, (w // 10)::INT AS provider, (w % 10)::BIGINT AS attempt, CASE WHEN w IS NOT NULL THEN NULL WHEN f IS NULL THEN s WHEN s IN ('no_captions', 'language_missing') THEN s ELSE f END AS error FROM r""")
def _(t):
    d = F.col("doc_id")
    c = t.documents.select(
        F.floor(d / 4).cast("bigint").alias("media_id"), (F.floor((d % 4) / 2) + 1).cast("int").alias("provider"), (d % 2).alias("attempt"),
        F.col("lang").isin("en", "de").alias("ok"), F.col("lang").alias("language"),
        F.when(F.col("lang") == "fr", "no_captions").when(F.col("lang") == "es", "unavailable").alias("error"))
    return R.resolve_captures(c, "en")


# -- search and statistics ---------------------------------------------------------------


@query("flt01_noise_cues", """SELECT conv_id, turn, regexp_matches(x, '^\\s*(\\[[^\\]]+\\]|\\([^)]+\\)|♪+|♫+)\\s*$') AS noise FROM (SELECT conv_id, turn,
  CASE role WHEN 'system' THEN ' [' || text || '] ' WHEN 'assistant' THEN '♪♪' ELSE text END AS x FROM conversations)""")
def _(t):
    x = F.when(F.col("role") == "system", F.concat(F.lit(" ["), "text", F.lit("] "))).when(F.col("role") == "assistant", "♪♪").otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.regexp_like(x, F.lit(T.NOISE_ONLY)).alias("noise"))


@query("flt02_blank_text", f"SELECT doc_id, count(*)::BIGINT AS kept FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS l FROM documents) WHERE {S.trim('l')} <> '' GROUP BY 1")
def _(t):
    return spoken(doc_paragraphs(t)).groupBy(F.col("media_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("kept"))


@query("flt04_paragraph_search", f"WITH {PARAGRAPHS_SQL} SELECT media_id, seq, text FROM paragraphs WHERE contains(lower(text), 'tion') OR contains(lower(coalesce(speaker, '')), 'tion')")
def _(t):
    return Q.search_paragraphs(paragraphs(t), "TION").select("media_id", "seq", "text")


@query("flt05_history_search", f"""WITH {PARAGRAPHS_SQL}, b AS (SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS body FROM paragraphs GROUP BY 1)
SELECT c.conv_id AS media_id FROM conversations c LEFT JOIN b ON b.media_id = c.conv_id WHERE c.turn = 0 AND contains(lower(concat(c.role, ' ', coalesce(b.body, ''), ' ')), 'e la')""")
def _(t):
    jobs = t.conversations.where(F.col("turn") == 0).select(F.col("conv_id").alias("media_id"), F.col("role").alias("title"))
    return Q.search_history(jobs, paragraphs(t), "E la")


@query("flt05_history_search_slides", f"""WITH {PARAGRAPHS_SQL}, b AS (SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS body FROM paragraphs GROUP BY 1)
SELECT c.conv_id AS media_id FROM conversations c JOIN documents d ON d.doc_id = c.conv_id LEFT JOIN b ON b.media_id = c.conv_id
WHERE c.turn = 0 AND contains(lower(concat(c.role, ' ', coalesce(b.body, ''), ' ', d.lang, ' ', d.source, ' ', d.text, ' ')), 'en src')""")
def _(t):
    jobs = t.conversations.where(F.col("turn") == 0).select(F.col("conv_id").alias("media_id"), F.col("role").alias("title"))
    slides = t.documents.select(F.col("doc_id").alias("media_id"), F.posexplode(F.array("lang", "source", "text")).alias("ord", "text"))
    with_slides = jobs.join(t.documents.select(F.col("doc_id").alias("media_id")), "media_id")
    return Q.search_history(with_slides, paragraphs(t), "en SRC", slides)


HISTORY_TERMS = ("e la", "ion", "s", "the assistant", "no such words here")


@query("flt05_history_index", f"""WITH {PARAGRAPHS_SQL}, b AS (SELECT media_id, string_agg(text, ' ' ORDER BY seq) AS body FROM paragraphs GROUP BY 1),
terms AS (SELECT unnest({list(HISTORY_TERMS)}) AS term)
SELECT term, c.conv_id AS media_id FROM conversations c JOIN b ON b.media_id = c.conv_id, terms WHERE c.turn = 0 AND contains(lower(concat(c.role, ' ', b.body, ' ')), term)""")
def _(t):
    jobs = t.conversations.where(F.col("turn") == 0).select(F.col("conv_id").alias("media_id"), F.col("role").alias("title"))
    index = Q.build_history_index(jobs.join(paragraphs(t).select("media_id").distinct(), "media_id"), paragraphs(t))
    found = [index.search(term.upper()).select(F.lit(term).alias("term"), "media_id") for term in HISTORY_TERMS]
    return reduce(DataFrame.unionByName, found)


@query("ag11_term_counts", """WITH terms AS (SELECT DISTINCT lower(regexp_extract(text, '^[^ ,.]+')) AS term FROM benchmark),
h AS (SELECT term, (length(lower(d.text)) - length(replace(lower(d.text), term, ''))) / length(term) AS n FROM documents d, terms)
SELECT term, sum(n)::BIGINT AS n FROM h GROUP BY term""")
def _(t):
    first = F.lower(F.regexp_extract("text", "^[^ ,.]+", 0))
    terms = t.benchmark.select(F.explode(F.array(first, F.concat(first, F.lit(" ")), F.lit(" "))).alias("term"))
    return Q.term_counts(t.documents, "text", terms)


@query("ag10_read_minutes", f"""SELECT doc_id, ({S.words('text')})::BIGINT AS words, greatest(1, round(({S.words('text')}) / CASE WHEN starts_with(lower(lang), 'ko') OR {S.count('text', S.HANGUL)} > 0 THEN 380.0 ELSE 220.0 END))::BIGINT AS minutes FROM documents""")
def _(t):
    w = T.word_count(F.col("text"))
    return t.documents.select("doc_id", w.alias("words"), K.read_minutes(w, F.col("lang"), T.hangul_count(F.col("text")) > 0).alias("minutes"))


@query("ag06_duration_count", f"WITH {SEGMENTS_SQL} SELECT media_id, max(start_ms + dur_ms)::BIGINT AS duration_ms, count(*)::BIGINT AS segment_count FROM segments GROUP BY 1")
def _(t):
    return extent(segments(t))
