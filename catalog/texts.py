"""Column expressions of the text and time rules, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.adapters import PARAGRAPHS_SQL, SEGMENTS_SQL, paragraphs, segments
from catalog.base import query
from cuelake.functions import clock as K
from cuelake.functions import text as T
from cuelake.functions.arrays import posexplode_rows
from cuelake.operators.chunks import similarity
from cuelake.operators.ordered import Scan, ordered_scan, row_block
from cuelake.sources.links import canonicalize_links

# -- cleaning single texts ---------------------------------------------------------------

_NUM = r"""CASE WHEN len(regexp_extract_all({x}, '{p}')) = 0 THEN {x} ELSE
  concat(regexp_split_to_array({x}, '{p}')[1], list_reduce(list_prepend('', list_transform(
    range(1, len(regexp_extract_all({x}, '{p}')) + 1),
    lambda i: concat(chr(regexp_extract_all({x}, '{p}', 1)[i]::INT),
                     regexp_split_to_array({x}, '{p}')[i + 1]))), lambda a, b: concat(a, b))) END"""


def decoded_sql(x: str) -> str:
    out = _NUM.replace("{x}", x).replace("{p}", "&#([0-9]+);")
    for name, char in T.NAMED_ENTITIES.items():
        plain = char.replace("'", "''")
        out = f"regexp_replace({out}, '&{name};', '{plain}', 'gi')"
    return out


@query("str01_decode_entities", f"""SELECT page_id, length({decoded_sql('html')})::BIGINT AS n_chars,
  md5({decoded_sql('html')}) AS digest FROM pages""")
def _(t):
    d = T.decode_entities(F.col("html"))
    return t.pages.select(
        "page_id", F.length(d).cast("bigint").alias("n_chars"), F.md5(d.cast("binary")).alias("digest")
    )


_MARKED = "concat('>> » [Music] ', text, ' (laughter) &gt;')"
_NORM = S.trim(
    "regexp_replace(regexp_replace("
    f"regexp_replace(regexp_replace(x, '^(?:>>|»)+[{S.SP}]*', ''), "
    f"'[{S.SP}]*[\\[(](?:{T.NOISE_WORDS})[\\])][{S.SP}]*', ' ', 'gi'), "
    f"'[{S.SP}]*\\n+[{S.SP}]*', ' ', 'g'), '[ \\t]+', ' ', 'g')"
)


@query("str02_normalize_cue_text", f"""SELECT doc_id, {_NORM} AS text FROM (
  SELECT doc_id, replace({decoded_sql('m')}, chr(160), ' ') AS x
  FROM (SELECT doc_id, {_MARKED} AS m FROM documents))""")
def _(t):
    marked = F.concat(F.lit(">> » [Music] "), F.col("text"), F.lit(" (laughter) &gt;"))
    return t.documents.select("doc_id", T.normalize_cue_text(marked).alias("text"))


@query("str03_fold_key", f"""SELECT doc_id, md5({S.key('text')}) AS digest,
  length({S.key('text')})::BIGINT AS compact_len FROM documents""")
def _(t):
    k = T.fold_key(F.col("text"))
    return t.documents.select(
        "doc_id", F.md5(k.cast("binary")).alias("digest"), F.length(k).cast("bigint").alias("compact_len")
    )


@query("str06_dedupe_repeated_phrases")
def _(t):
    return segments(t).select(
        "media_id", "seq", T.dedupe_repeated_phrases(F.concat_ws(" ", "text", "text")).alias("text")
    )


@query("str09_korean_heavy", f"""SELECT doc_id, {S.count('text', S.HANGUL)}::BIGINT AS hangul,
  ({S.count('text', S.HANGUL)} >= 8 AND {S.count('text', S.HANGUL)} * 2 >=
   length(regexp_replace(text, '[{S.SP}]', '', 'g'))) AS heavy FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", T.hangul_count(F.col("text")).cast("bigint").alias("hangul"),
        T.is_korean_heavy(F.col("text")).alias("heavy"),
    )


# -- neighbouring cues -------------------------------------------------------------------

PAIRS_SQL = SEGMENTS_SQL + """,
pair0 AS (SELECT media_id, seq, lag(text) OVER w AS a, text AS b, lag(speaker) OVER w AS who_a,
  speaker AS who_b, start_ms - lag(start_ms + dur_ms) OVER w AS gap_ms,
  start_ms + dur_ms - lag(start_ms) OVER w AS span_ms
  FROM segments WINDOW w AS (PARTITION BY media_id ORDER BY seq)),
pair AS (SELECT * FROM pair0 WHERE a IS NOT NULL)"""


def pairs(t):
    s = segments(t)
    end = F.col("start_ms") + F.col("dur_ms")
    seen = ordered_scan(
        s, ["media_id"], ["seq"], row_block(),
        [
            Scan("prev", "lag", F.struct("text", "speaker", "start_ms", end.alias("end_ms"))),
        ],
    )
    return seen.where(F.col("prev").isNotNull()).select(
        "media_id", "seq", F.col("prev.text").alias("a"), F.col("text").alias("b"),
        F.col("prev.speaker").alias("who_a"), F.col("speaker").alias("who_b"),
        (F.col("start_ms") - F.col("prev.end_ms")).alias("gap_ms"),
        (end - F.col("prev.start_ms")).alias("span_ms"),
    )


@query("str04_suffix_prefix_overlap", f"""WITH {PAIRS_SQL}
SELECT media_id, seq, ({S.overlap('a', "concat(right(a, seq::INT % 17), b)")})::BIGINT AS shared,
  ({S.overlap('a', 'b')})::BIGINT AS plain FROM pair""")
def _(t):
    tail = F.concat(F.right(F.col("a"), (F.col("seq") % 17).cast("int")), F.col("b"))
    return pairs(t).select(
        "media_id", "seq", T.suffix_prefix_overlap(F.col("a"), tail).cast("bigint").alias("shared"),
        T.suffix_prefix_overlap(F.col("a"), F.col("b")).cast("bigint").alias("plain"),
    )


@query("str05_join_cue", f"""WITH {PAIRS_SQL},
o AS (SELECT *, {S.overlap('a', 'b')} AS ov FROM
  (SELECT media_id, seq, a, concat(right(a, seq::INT % 17), b) AS b FROM pair))
SELECT media_id, seq, {S.join_cue('a', 'b', 'ov')} AS text FROM o""")
def _(t):
    tail = F.concat(F.right(F.col("a"), (F.col("seq") % 17).cast("int")), F.col("b"))
    return pairs(t).select("media_id", "seq", T.join_cue(F.col("a"), tail).alias("text"))


@query("str07_pick_longer", f"""WITH {PAIRS_SQL},
o AS (SELECT media_id, seq, a, b, {S.overlap('a', 'b')} AS ov, {S.key('a')} AS x, {S.key('b')} AS y
  FROM (SELECT media_id, seq, a, CASE WHEN gap_ms >= 2000 THEN concat(a, ' ', b) ELSE b END AS b
        FROM pair))
SELECT media_id, seq, CASE WHEN contains(y, x) AND length(y) > length(x) THEN b
  WHEN contains(x, y) THEN a ELSE {S.join_cue('a', 'b', 'ov')} END AS text FROM o""")
def _(t):
    longer = F.when(F.col("gap_ms") >= 2000, F.concat_ws(" ", "a", "b")).otherwise(F.col("b"))
    return pairs(t).select("media_id", "seq", T.pick_longer(F.col("a"), longer).alias("text"))


@query("str08_should_collapse", f"""WITH {PAIRS_SQL},
o AS (SELECT media_id, seq, a, b, gap_ms, {S.key('a')} AS x, {S.key('b')} AS y FROM pair)
SELECT media_id, seq, (x <> '' AND y <> '' AND gap_ms < 4200 AND (starts_with(y, x)
  OR starts_with(x, y) OR (length(x) >= 4 AND contains(y, x)) OR (length(y) >= 4 AND contains(x, y))
  OR {S.overlap('x', 'y')} >= CASE WHEN regexp_matches(a || b, '{S.HANGUL}') THEN 2 ELSE 4 END
  OR {S.overlap('a', 'b')} >= CASE WHEN regexp_matches(a || b, '{S.HANGUL}') THEN 2 ELSE 4 END)) AS collapse
FROM o""")
def _(t):
    return pairs(t).select("media_id", "seq", T.should_collapse(F.col("a"), F.col("b"), F.col("gap_ms")).alias("collapse"))


_DIFF = "coalesce(who_a <> who_b, false)"


@query("str10_should_break_sentence", f"""WITH {PAIRS_SQL}
SELECT media_id, seq, CASE WHEN {_DIFF} THEN true
  WHEN who_b IS NOT NULL AND length({S.key('a')}) > 8 THEN true
  WHEN length({S.key('a')}) <= 6 AND gap_ms < 5000 THEN false
  WHEN gap_ms >= 3200 THEN true
  WHEN regexp_matches(a, '{S.END}') THEN gap_ms >= 250
  WHEN regexp_matches(a, '[a-z0-9)]$') AND regexp_matches(b, '^[A-Z]') AND gap_ms >= 800 THEN true
  ELSE false END AS breaks FROM pair""")
def _(t):
    return pairs(t).select(
        "media_id", "seq",
        T.should_break_sentence(
            F.col("a"), F.col("b"), F.col("gap_ms"), F.col("who_a"), F.col("who_b"), F.col("who_b").isNotNull()
        ).alias("breaks"),
    )


@query("str11_should_break_paragraph", f"""WITH {PAIRS_SQL}
SELECT media_id, seq, CASE WHEN {_DIFF} THEN true
  WHEN who_b IS NOT NULL AND length({S.key('a')}) > 8 THEN true
  WHEN length({S.key('a')}) <= 6 AND gap_ms < 5000 THEN false
  WHEN gap_ms >= 2600 THEN true
  WHEN regexp_matches(a, '{S.END}') AND (gap_ms >= 700 OR span_ms >= 8000) THEN true
  ELSE span_ms >= 14000 END AS breaks FROM pair""")
def _(t):
    return pairs(t).select(
        "media_id", "seq",
        T.should_break_paragraph(
            F.col("a"), F.col("who_b").isNotNull(), F.col("gap_ms"), F.col("span_ms"), F.col("who_a"),
            F.col("who_b"),
        ).alias("breaks"),
    )


def _ascii(x):
    """DuckDB's levenshtein counts bytes: lower-case letters beyond ASCII become capitals."""
    return f"translate({x}, 'àâäáçéèêëíìîïñóòôöúùûüß', 'ABCDEFGHIJKLMNOPQRSTUVW')"


@query("str16_overlap_similarity", f"""WITH {PAIRS_SQL},
o AS (SELECT media_id, seq, {_ascii(S.key('a'))} AS x, {_ascii(S.key('b'))} AS y FROM pair)
SELECT media_id, seq, round(CASE WHEN x = '' OR y = '' THEN 0.0 WHEN x = y THEN 1.0
  ELSE 1.0 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) END, 6) AS similarity FROM o""")
def _(t):
    x, y = T.fold_key(F.col("a")), T.fold_key(F.col("b"))
    return pairs(t).select("media_id", "seq", F.round(similarity(x, y), 6).alias("similarity"))


# -- speakers ----------------------------------------------------------------------------

_LABELLED = (
    r"^(?:\[([^\]]{1,40})\]|([A-Za-z가-힣][A-Za-z가-힣0-9 .''-]{0,32}))"
    rf"[{S.SP}]*[:：][{S.SP}]+((?s).+)$"
)


@query("str12_peel_speaker", f"""WITH l AS (SELECT conv_id, turn, {S.trim('text')} AS x FROM
   (SELECT conv_id, turn, concat('>> ', CASE WHEN turn = 0 THEN '[' || role || ']' ELSE role END,
     ': ', text) AS text FROM conversations)),
m AS (SELECT *, {S.trim(f"regexp_replace(x, '^((>>|»)[{S.SP}]*)+', '')")} AS y FROM l),
n AS (SELECT *, {S.trim(f"coalesce(nullif(regexp_extract(y, '{_LABELLED}', 1), ''), regexp_extract(y, '{_LABELLED}', 2))")} AS name FROM m),
o AS (SELECT *, name <> '' AND (NOT {S.false_speaker('name')} OR regexp_matches(name, '^[A-Za-z]$')) AS lifted FROM n)
SELECT conv_id, turn, CASE WHEN lifted THEN name END AS speaker,
  CASE WHEN lifted THEN {S.trim(f"regexp_extract(y, '{_LABELLED}', 3)")} ELSE y END AS text,
  (lifted OR regexp_matches(x, '^(>>|»)')) AS turn_mark FROM o""")
def _(t):
    who = F.when(F.col("turn") == 0, F.concat(F.lit("["), "role", F.lit("]"))).otherwise(F.col("role"))
    line = F.concat(F.lit(">> "), who, F.lit(": "), F.col("text"))
    return t.conversations.select("conv_id", "turn", T.peel_speaker(line).alias("p")).select(
        "conv_id", "turn", "p.speaker", "p.text", "p.turn_mark"
    )


@query("flt07_false_speakers", f"""WITH n AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.,\\n]+')) AS raw FROM benchmark),
m AS (SELECT item_id, raw, {S.trim('raw')} AS name FROM n)
SELECT item_id, raw, {S.false_speaker('name')} AS is_false FROM m""")
def _(t):
    raw = t.benchmark.select("item_id", F.explode(F.split("text", "[.,\\n]+")).alias("raw"))
    return raw.withColumn("is_false", T.is_false_speaker(F.col("raw")))


_RAW_SQL = "CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'speaker 2' ELSE role END"


def _raw():
    return F.when(F.col("role") == "user", "A").when(
        F.col("role") == "assistant", "speaker 2"
    ).otherwise(F.col("role"))


@query("str13_remap_speaker", f"""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Ana'
  WHEN role = 'assistant' THEN 'Ben' WHEN lower(role) = 'ana' THEN 'Ana' ELSE role END AS speaker
FROM conversations""")
def _(t):
    names = F.array(F.lit("Ana"), F.lit("Ben"))
    return t.conversations.select("conv_id", "turn", T.remap_speaker(_raw(), names).alias("speaker"))


@query("str14_apply_names", f"""SELECT media_id, seq, CASE speaker WHEN 'user' THEN 'Ana'
  WHEN 'assistant' THEN 'Ben' WHEN 'system' THEN 'system' END AS speaker
FROM (WITH {SEGMENTS_SQL} SELECT * FROM segments)""")
def _(t):
    names = T.plausible_names(F.array(F.lit(" Ana "), F.lit("Ben"), F.lit("x"), F.lit("chapter 1")))
    raw = F.when(F.col("speaker") == "user", "A").when(
        F.col("speaker") == "assistant", "speaker 2"
    ).otherwise(F.col("speaker"))
    return segments(t).select("media_id", "seq", T.remap_speaker(raw, names).alias("speaker"))


_NAME_LINE = (
    rf"(?:^|\n)[{S.SP}]*[-*•]?[{S.SP}]*(?:\*\*)?"
    rf"([A-Za-z가-힣][A-Za-z가-힣0-9·.{S.SP}]{{0,24}}?)(?:\*\*)?[{S.SP}]*[:：]"
)


@query("str28_speakers_from_summary", f"""WITH s AS (SELECT conv_id, turn,
    concat('- **', role, '**: ', replace(text, '. ', chr(10) || '* Guest ' || turn || ': '), chr(10), 'note: x') AS summary FROM conversations),
n AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(summary, '{_NAME_LINE}', 1),
    lambda x: {S.squash('x')}), lambda n: n <> '' AND NOT {S.false_speaker('n')}) AS names FROM s)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(list_filter(range(1, len(names) + 1),
   lambda i: list_position(names, names[i]) = i)[1:6], lambda i: names[i]), '|'), '') AS names FROM n""")
def _(t):
    summary = F.concat(
        F.lit("- **"), "role", F.lit("**: "),
        F.replace(F.col("text"), F.lit(". "), F.concat(F.lit("\n* Guest "), F.col("turn"), F.lit(": "))),
        F.lit("\nnote: x"),
    )
    return t.conversations.select(
        "conv_id", "turn", F.array_join(T.speakers_from_summary(summary), "|").alias("names")
    )


@query("flt08_questions", f"""SELECT conv_id, turn, {S.question("CASE WHEN role = 'user' THEN text || ' ? ' ELSE text END")} AS asks
FROM conversations""")
def _(t):
    text = F.when(F.col("role") == "user", F.concat("text", F.lit(" ? "))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", T.looks_like_question(text).alias("asks"))


# -- summaries and search ----------------------------------------------------------------


@query("str18_clip_at_boundary", f"""SELECT doc_id, {S.clip('text', 110)} AS clipped,
  {S.clip('text', 40)} AS short FROM documents""")
def _(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", T.clip_at_boundary(x, 110).alias("clipped"), T.clip_at_boundary(x, 40).alias("short")
    )


@query("str19_shorten_point", f"""SELECT doc_id, {S.shorten('text')} AS point FROM (
  SELECT doc_id, '- ' || text || ' [music] ' AS text FROM documents)""")
def _(t):
    line = F.concat(F.lit("- "), "text", F.lit(" [music] "))
    return t.documents.select("doc_id", T.shorten_point(line).alias("point"))


@query("str20_split_sentences", f"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace({S.strip_noise('text')}, '([{T.SENTENCE_MARKS}])[{S.SP}]+', '\\1' || chr(1), 'g'), '((?:니다|까요|세요|죠))[{S.SP}]+', '\\1' || chr(1), 'g') AS x FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(string_split(x, chr(1)), lambda s: {S.trim('s')}), lambda s: length(s) >= 10) AS parts FROM c)
SELECT doc_id, (i - 1)::INT AS pos, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)""")
def _(t):
    return posexplode_rows(t.documents, ["doc_id"], T.split_sentences(F.col("text")), "pos", "sentence")


SENTENCES_SQL = r"""sent AS (SELECT doc_id, parts[i] AS s, i - 1 AS idx, len(parts) AS n FROM (
  SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id,
    list_filter(list_transform(regexp_split_to_array(text, '[.\n]+'), lambda x: trim(x)),
                lambda x: length(x) >= 10) AS parts FROM documents)))"""


def doc_sentences(t):
    parts = F.filter(
        F.transform(F.split("text", "[.\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 10
    )
    base = t.documents.select("doc_id", parts.alias("parts")).withColumn("n", F.size("parts"))
    return posexplode_rows(base, ["doc_id", "n"], F.col("parts"), "idx", "s")


SCORE_SQL = f"""round(CASE WHEN pos <= 0.12 OR pos >= 0.72 THEN 1.4 ELSE 1.0 END::DOUBLE
  + CASE WHEN regexp_matches(s, '{T.SCORED_QUESTIONS}') THEN 1.6 ELSE 0 END::DOUBLE
  + CASE WHEN regexp_matches(s, '[0-9]') THEN 1.3 ELSE 0 END::DOUBLE
  + CASE WHEN length(s) BETWEEN 22 AND 140 THEN 1 ELSE 0 END::DOUBLE
  - CASE WHEN length(s) > 220 THEN 0.8 ELSE 0 END::DOUBLE
  - CASE WHEN {S.boilerplate('s')} THEN 3 ELSE 0 END::DOUBLE, 6)"""


@query("str21_score_sentence", f"""WITH {SENTENCES_SQL}
SELECT doc_id, idx::INT AS idx, {SCORE_SQL} AS score FROM (SELECT *, CASE WHEN n <= 1 THEN 0.5::DOUBLE
  ELSE idx::DOUBLE / (n - 1) END AS pos FROM sent)""")
def _(t):
    return doc_sentences(t).select(
        "doc_id", "idx", T.score_sentence(F.col("s"), F.col("idx"), F.col("n")).alias("score")
    )


@query("wn17_relative_position", f"""WITH {SENTENCES_SQL}
SELECT doc_id, idx::INT AS idx, round(CASE WHEN n <= 1 THEN 0.5::DOUBLE ELSE idx::DOUBLE / (n - 1) END, 6) AS pos FROM sent""")
def _(t):
    n = F.col("n")
    return doc_sentences(t).select(
        "doc_id", "idx",
        F.round(F.when(n <= 1, 0.5).otherwise(F.col("idx") / (n - 1)), 6).alias("pos"),
    )


@query("flt03_boilerplate", f"""WITH {SENTENCES_SQL}
SELECT doc_id, idx::INT AS idx, s FROM sent WHERE {S.boilerplate("s || CASE WHEN s LIKE '%the%' THEN ' thanks for watching' ELSE '' END")}""")
def _(t):
    said = F.concat("s", F.when(F.contains("s", F.lit("the")), " thanks for watching").otherwise(""))
    return doc_sentences(t).where(T.is_boilerplate(said)).select("doc_id", "idx", "s")


@query("str22_language_hint", f"""SELECT doc_id, CASE WHEN starts_with(lower(lang), 'ko')
  OR {S.count('text', S.HANGUL)} > 20 THEN 'ko' WHEN starts_with(lower(lang), 'en') THEN 'en' ELSE 'same' END AS hint FROM documents""")
def _(t):
    return t.documents.select("doc_id", T.language_hint(F.col("lang"), F.col("text")).alias("hint"))


@query("str24_highlight", """SELECT doc_id, regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi') AS text
FROM documents WHERE contains(lower(text), 'the')""")
def _(t):
    return t.documents.where(F.contains(F.lower("text"), F.lit("the"))).select(
        "doc_id", T.highlight(F.col("text"), "the").alias("text")
    )


@query("str26_escapes", f"""SELECT doc_id, concat('"', replace(text, '"', '""'), '"') AS csv,
  {S.html('text')} AS html, {S.md('text')} AS md FROM documents""")
def _(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", T.csv_cell(x).alias("csv"), T.escape_html(x).alias("html"),
        T.markdown_escape(x).alias("md"),
    )


@query("str27_labels", """SELECT doc_id, CASE WHEN lower(lang) = 'ko' OR starts_with(lower(lang), 'ko-') THEN 'Korean'
    WHEN lower(lang) = 'en' OR starts_with(lower(lang), 'en-') THEN 'English' ELSE lang END AS language,
  CASE source WHEN 'src0' THEN 'Meeting' WHEN 'src1' THEN 'AI conference' ELSE 'General' END AS kind,
  CASE source WHEN 'src0' THEN 'Transcribed audio' WHEN 'src1' THEN 'Auto-generated' ELSE 'Manual' END AS source_type,
  CASE source WHEN 'src0' THEN 'Chunk-estimated (approximate)' WHEN 'src1' THEN 'Provider timing'
    ELSE 'Source caption timing' END AS quality FROM documents""")
def _(t):
    pick = lambda a, b, c: F.when(F.col("source") == "src0", a).when(
        F.col("source") == "src1", b
    ).otherwise(c)
    return t.documents.select(
        "doc_id", T.language_name(F.col("lang")).alias("language"),
        T.summary_kind_label(pick("meeting", "ai-conference", "unknown")).alias("kind"),
        T.source_type_label(pick("transcription", "asr", "manual")).alias("source_type"),
        T.timestamp_quality_label(pick("chunk-estimated", "provider", "source")).alias("quality"),
    )


# -- links -------------------------------------------------------------------------------

_LINK_FORMS = [
    "'https://www.youtube.com/watch?v=' || id || '&t=4'", "'youtu.be/' || id || '&feature=share'",
    "'https://m.youtube.com/shorts/' || id || '?x=1'", "id",
    "'https://www.youtube-nocookie.com/embed/' || id", "'https://youtube.com/watch?v=short'",
    "'https://www.youtube.com/attribution_link?a=1&u=%2Fwatch%3Fv%3D' || id || '%26feature%3Dx'",
    "'https://www.youtube.com/@channel'", "''", "url", "'  https://youtube.com/live/' || id || ' '",
]
_ID_SQL = "left(md5(page_id::VARCHAR), 11)"


def link_table(t):
    base = t.pages.select("page_id", "url", F.left(F.md5(F.col("page_id").cast("string").cast("binary")), F.lit(11)).alias("id"))
    forms = F.array(*[F.expr(f) for f in _LINK_FORMS])
    return base.select("page_id", "id", F.posexplode(forms).alias("form", "link"))


@query("str23_canonical_links", f"""WITH b AS (SELECT page_id, url, {_ID_SQL} AS id FROM pages),
l AS (SELECT page_id, id, unnest([{', '.join(_LINK_FORMS)}]) AS link, generate_subscripts([{', '.join(_LINK_FORMS)}], 1) - 1 AS form FROM b)
SELECT page_id, form::INT AS form, CASE WHEN form IN (0, 1, 2, 3, 4, 6, 10) THEN id END AS video_id,
  CASE WHEN form IN (0, 1, 2, 3, 4, 6, 10) THEN 'https://www.youtube.com/watch?v=' || id END AS canonical_url,
  CASE WHEN form IN (0, 1, 2, 3, 4, 6, 10) THEN NULL WHEN form = 8 THEN 'blank' WHEN form = 5 THEN 'bad_id' ELSE 'not_a_video_link' END AS problem FROM l""")
def _(t):
    return canonicalize_links(link_table(t), "link").select(
        "page_id", "form", "video_id", "canonical_url", "problem"
    )


# -- times -------------------------------------------------------------------------------


@query("dt01_timestamps", f"""WITH {SEGMENTS_SQL} SELECT media_id, seq, {S.stamp('start_ms * 60')} AS stamp,
  concat('[', {S.stamp('start_ms')}, ']') AS inline_stamp FROM segments""")
def _(t):
    return segments(t).select(
        "media_id", "seq", K.format_timestamp(F.col("start_ms") * 60).alias("stamp"),
        K.format_inline_timestamp(F.col("start_ms")).alias("inline_stamp"),
    )


_SEC = "round(start_ms * 20 / 1000.0)::BIGINT"


@query("dt02_duration_clock", f"""WITH {SEGMENTS_SQL} SELECT media_id, seq, CASE
  WHEN {_SEC} >= 3600 THEN concat({_SEC} // 3600, 'h ', {S.pad(f'{_SEC} % 3600 // 60')}, 'm')
  WHEN {_SEC} >= 60 THEN concat({_SEC} // 60, 'm ', {S.pad(f'{_SEC} % 60')}, 's')
  ELSE concat({_SEC}, 's') END AS spoken FROM segments""")
def _(t):
    return segments(t).select(
        "media_id", "seq", K.format_duration_clock(F.col("start_ms") * 20).alias("spoken")
    )


@query("dt03_clock_ms", f"""WITH {SEGMENTS_SQL} SELECT media_id, seq, {S.clock('start_ms * 31')} AS srt,
  {S.clock('start_ms * 31', '.')} AS slide FROM segments""")
def _(t):
    at = F.col("start_ms") * 31
    return segments(t).select(
        "media_id", "seq", K.format_clock_ms(at).alias("srt"), K.format_clock_ms(at, ".").alias("slide")
    )


@query("dt04_parse_times", f"""WITH {SEGMENTS_SQL}, s AS (SELECT media_id, seq, start_ms * 60 // 1000 AS sec FROM segments)
SELECT media_id, seq, sec::DOUBLE AS seconds, CASE WHEN sec // 3600 <= 99 THEN sec END::BIGINT AS token FROM s""")
def _(t):
    stamp = K.format_timestamp(F.col("start_ms") * 60)
    return segments(t).select(
        "media_id", "seq", K.parse_duration(stamp).alias("seconds"),
        K.parse_timestamp_token(F.concat(F.lit("["), stamp, F.lit("]"))).alias("token"),
    )


_AS_OF = 1_712_000_000_000
_MIN = f"round(greatest(0, {_AS_OF} - epoch_us(ts) // 1000) / 60000.0)"


@query("dt05_relative_age", f"""SELECT event_id, CASE WHEN {_MIN} < 1 THEN 'just now'
  WHEN {_MIN} < 60 THEN concat({_MIN}::BIGINT, 'm ago')
  WHEN round({_MIN} / 60) < 24 THEN concat(round({_MIN} / 60)::BIGINT, 'h ago')
  ELSE concat(round(round({_MIN} / 60) / 24)::BIGINT, 'd ago') END AS age FROM events""")
def _(t):
    return t.events.select(
        "event_id",
        K.relative_age(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(_AS_OF)).alias("age"),
    )
