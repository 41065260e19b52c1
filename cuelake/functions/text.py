"""Column expressions for caption text. Lengths are counted in code points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions import breaks

# The white space, marks, endings and word lists the results depend on.
SPACE = "\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
# Before a pattern that begins with white space: printable ASCII is passed over by one test of a range.
MAY_BE_SPACE = "(?![!-~])"
HANGUL = "[\\uAC00-\\uD7A3]"
SENTENCE_MARKS = ".!?…。？！"
SENTENCE_END = "[.!?…。？！][\"'”’)]*$"
NOISE_ONLY = f"^[{SPACE}]*(\\[[^\\]]+\\]|\\([^)]+\\)|♪+|♫+)[{SPACE}]*$"
NOISE_WORDS = "음악|웃음|박수|intro|music|laughter|applause"
FALSE_SPEAKERS = [
    "http", "https", "time", "note", "update", "warning", "music", "applause", "laughter",
    "narrator", "summary", "overview", "transcript", "자막", "음악", "박수", "웃음", "시간",
    "요약", "제목",
]
FALSE_PREFIXES = "chapter|part|scene|track|http|speaker"
BOILERPLATE = "구독|좋아요|고정\\s*댓글|참고하세요|알람|알림\\s*설정|intro music|thanks for watching"
NAMED_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
QUESTION_ENDINGS = "까요|나요|세요|습니까|입니까|죠"
SCORED_QUESTIONS = "[?？]|까요|나요|습니까|입니까"
LABELLED = (
    "^(?:\\[([^\\]]{1,40})\\]|([A-Za-z가-힣][A-Za-z가-힣0-9 .'-]{0,32}))"
    f"[{SPACE}]*[:：][{SPACE}]+([\\s\\S]+)$"
)
NAME_LINE = (
    f"(?:^|\\n)[{SPACE}]*[-*•]?[{SPACE}]*(?:\\*\\*)?"
    f"([A-Za-z가-힣][A-Za-z가-힣0-9·.{SPACE}]{{0,24}}?)(?:\\*\\*)?[{SPACE}]*[:：]"
)


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def squash(c: Column) -> Column:
    return F.trim(squash_inner(c))  # no other white space is left


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"{MAY_BE_SPACE}(?:^[{SPACE}]+|[{SPACE}]+$)", "")


def present(c: Column) -> Column:
    """A speaker or text that is neither null nor empty."""
    return c.isNotNull() & (c != "")


# -- entities and cue text ---------------------------------------------------------------


def _code_point(digits: Column, radix: int) -> Column:
    number = F.conv(digits, radix, 10).cast("bigint")
    raw = F.unhex(F.lpad(F.conv(digits, radix, 16), 8, "0"))
    return F.when(
        (F.length(digits) <= 8) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF),
        F.decode(raw, "UTF-32"),
    )


def _decode_numeric(c: Column, pattern: str, radix: int, prefix: str) -> Column:
    pieces = F.split(c, pattern)
    digits = F.regexp_extract_all(c, F.lit(pattern), 1)
    tail = F.slice(pieces, 2, F.size(digits))
    decoded = F.zip_with(
        digits,
        tail,
        lambda d, rest: F.concat(
            F.coalesce(_code_point(d, radix), F.concat(F.lit(prefix), d, F.lit(";"))), rest
        ),
    )
    return F.when(F.size(digits) > 0, F.concat(pieces[0], F.array_join(decoded, ""))).otherwise(c)


def decode_entities(c: Column) -> Column:
    """Decimal, then hexadecimal, then named entities; each in a single left-to-right pass."""
    out = _decode_numeric(c, "&#(\\d+);", 10, "&#")
    out = _decode_numeric(out, "(?i)&#x([0-9a-f]+);", 16, "&#x")
    for name, char in NAMED_ENTITIES.items():
        out = F.regexp_replace(out, f"&(?i:{name});", char)
    return out


def strip_leading_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"^(?:>>|»)+[{SPACE}]*", "")


def drop_noise_words(c: Column) -> Column:
    return F.regexp_replace(c, f"(?iu)[{SPACE}]*[\\[(](?:{NOISE_WORDS})[\\])][{SPACE}]*", " ")


def may_change(c: Column) -> Column:
    """False only for text that `normalize_cue_text` surely leaves as it is: a few searches that spare most cues
    its steps. White space and marks that are not ASCII are looked for by the bytes they begin with first."""
    marks = [c.startswith(">>"), c.startswith(" "), c.endswith(" ")]
    inside = [c.contains(mark) for mark in ("  ", "&", "(", "[", "\n", "\t", "\x0b", "\f", "\r")]
    leads = dict.fromkeys(x.encode()[:2] for x in "»\x85\u00a0\u1680\u2000\u2028\u202f\u205f\u3000\ufeff")
    led = reduce(lambda a, b: a | b, [F.contains(c.cast("binary"), F.lit(lead)) for lead in leads])
    wide = (F.octet_length(c) > F.length(c)) & led & F.regexp_like(c, F.lit(f"(?![ -~])[»\\x85{SPACE}]"))
    return reduce(lambda a, b: a | b, [*marks, *inside, wide])


def normalize_cue_text(c: Column) -> Column:
    out = F.replace(decode_entities(c), F.lit("\u00a0"), F.lit(" "))
    out = drop_noise_words(strip_leading_marks(out))
    out = F.regexp_replace(out, f"{MAY_BE_SPACE}[{SPACE}]*\\n+[{SPACE}]*", " ")
    return trim(F.regexp_replace(out, "[ \\t]+", " "))


def fold_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", ""))


def compact_len(c: Column) -> Column:
    return F.length(fold_key(c))


def dedupe_repeated_phrases(c: Column, passes: int = 8) -> Column:
    """Collapse immediate repeats. Each rule is a fixed point once nothing changes."""
    marks = f"[{SENTENCE_MARKS}]"
    edge = f"(?= |$|{marks})"

    def one_pass(t: Column) -> Column:
        t = F.when(
            F.regexp_count(t, F.lit(marks)) > 1,
            F.regexp_replace(t, f"([^{SENTENCE_MARKS}]{{4,}}{marks})(?: *\\1)+", "$1"),
        ).otherwise(t)
        # A repeated phrase shows its last six characters again before an edge: a cheap test
        # that spares most texts the quadratic search.
        t = F.when(
            F.regexp_like(t, F.lit(f"(.{{6}}) .*\\1{edge}")),
            F.regexp_replace(t, f"(.{{6,}}?) +\\1{edge}", "$1"),
        ).otherwise(t)
        t = F.regexp_replace(t, f"({HANGUL}{{2,8}})(?: *\\1){{2,}}", "$1")
        return F.regexp_replace(
            t,
            "(?i)(?<![A-Za-z0-9_])([A-Za-z]{3,})(?![A-Za-z0-9_])(?: +\\1(?![A-Za-z0-9_])){2,}",
            "$1",
        )

    # One pass body over a counter array; a pass that changed nothing ends the work.
    start = F.struct(squash(c).alias("text"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        after = F.transform(F.array(state["text"]), one_pass)[0]
        moved = F.transform(
            F.array(after), lambda t: F.struct(t.alias("text"), (t == state["text"]).alias("done"))
        )[0]
        return F.when(state["done"], state).otherwise(moved)

    return squash(F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step)["text"])


def suffix_prefix_overlap(a: Column, b: Column) -> Column:
    """Longest n from min(len) down to 4 (2 for short text) with suffix(a, n) = prefix(b, n)."""
    top = F.least(F.length(a), F.length(b))
    floor = F.when(top >= 12, 4).otherwise(2)
    hits = F.filter(
        F.sequence(floor, top), lambda n: F.substring(a, -n, n) == F.substring(b, F.lit(1), n)
    )
    return F.when(top >= floor, F.coalesce(F.array_max(hits), F.lit(0))).otherwise(F.lit(0))


def join_cue(prev: Column, nxt: Column) -> Column:
    overlap = suffix_prefix_overlap(prev, nxt)
    extra = trim(F.substring(nxt, overlap + 1, F.length(nxt)))
    glued = F.when(
        F.regexp_like(prev, F.lit(f"[{SPACE}(\\[{{‘“\"'/-]$"))
        | F.regexp_like(nxt, F.lit(f"^[{SPACE}.,!?…。？！)\\]’”'\"/-]")),
        F.concat(prev, nxt),
    ).otherwise(F.concat(prev, F.lit(" "), nxt))
    return (
        F.when(prev == "", nxt)
        .when(nxt == "", prev)
        .when(F.startswith(nxt, prev), nxt)
        .when(F.startswith(prev, nxt) & (F.length(nxt) < F.length(prev)), prev)
        .when((overlap > 0) & (extra == ""), prev)
        .when(
            overlap > 0,
            squash(F.concat(prev, F.when(F.endswith(prev, F.lit(" ")), "").otherwise(" "), extra)),
        )
        .otherwise(squash(glued))
    )


def pick_longer(prev: Column, nxt: Column) -> Column:
    a, b = fold_key(prev), fold_key(nxt)
    return (
        F.when(F.startswith(b, a) & (F.length(b) > F.length(a)), nxt)
        .when(F.startswith(a, b), prev)
        .when(F.contains(b, a) & (F.length(b) > F.length(a)), nxt)
        .when(F.contains(a, b), prev)
        .otherwise(join_cue(prev, nxt))
    )


def should_collapse(prev: Column, nxt: Column, gap_ms: Column) -> Column:
    a, b = fold_key(prev), fold_key(nxt)
    floor = F.when(F.regexp_like(F.concat(prev, nxt), F.lit(HANGUL)), 2).otherwise(4)
    related = (
        F.startswith(b, a)
        | F.startswith(a, b)
        | ((F.length(a) >= 4) & F.contains(b, a))
        | ((F.length(b) >= 4) & F.contains(a, b))
        | (suffix_prefix_overlap(a, b) >= floor)
        | (suffix_prefix_overlap(prev, nxt) >= floor)
    )
    return (a != "") & (b != "") & (gap_ms < 4200) & related


def hangul_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HANGUL))


def is_korean_heavy(c: Column) -> Column:
    hangul = hangul_count(c)
    return (hangul >= 8) & (hangul * 2 >= F.length(F.regexp_replace(c, f"[{SPACE}]", "")))


def ends_sentence(c: Column) -> Column:
    return F.regexp_like(c, F.lit(SENTENCE_END))


def speakers_differ(a: Column, b: Column) -> Column:
    return F.coalesce(present(a) & present(b) & (a != b), F.lit(False))


def should_break_sentence(
    prev: Column, nxt: Column, elapsed_ms: Column, prev_speaker: Column, next_speaker: Column,
    next_mark: Column,
) -> Column:
    korean = is_korean_heavy(F.concat(prev, nxt))
    facts = {
        **_break_facts(prev, prev_speaker, next_speaker, next_mark),
        "closed": ends_sentence(prev),
        "korean closed": korean & F.regexp_like(prev, F.lit(breaks.KOREAN_SENTENCE_END)),
        "capital follows": ~korean & F.regexp_like(prev, F.lit(breaks.LOW_END)) & F.regexp_like(nxt, F.lit(breaks.CAPITAL_START)),
    }
    return breaks.decided(breaks.SENTENCE_RULES, facts, elapsed_ms)


def should_break_paragraph(
    prev: Column, nxt_mark: Column, elapsed_ms: Column, span_ms: Column, prev_speaker: Column,
    next_speaker: Column,
) -> Column:
    stop = ends_sentence(prev) | F.regexp_like(prev, F.lit(breaks.KOREAN_PARAGRAPH_END))
    facts = {**_break_facts(prev, prev_speaker, next_speaker, nxt_mark), "stop": stop}
    return breaks.decided(breaks.PARAGRAPH_RULES, facts, elapsed_ms, span_ms)


def _break_facts(prev: Column, prev_speaker: Column, next_speaker: Column, next_mark: Column) -> dict[str, Column]:
    return {
        "any": F.lit(True), "other speaker": speakers_differ(prev_speaker, next_speaker),
        "turn mark": next_mark & (compact_len(prev) > breaks.MARKED_KEY), "short": compact_len(prev) <= breaks.SHORT_KEY,
    }


# -- speakers ----------------------------------------------------------------------------


def is_single_letter(c: Column) -> Column:
    return F.regexp_like(c, F.lit("^[A-Za-z]$"))


def is_false_speaker(name: Column) -> Column:
    n = trim(name)
    return (
        (n == "")
        | (F.length(n) > 40)
        | F.regexp_like(n, F.lit("^[0-9]+$"))
        | is_single_letter(n)
        | (F.size(F.split(n, f"[{SPACE}]+")) > 3)
        | F.regexp_like(n, F.lit(f"(?i)^(?:{FALSE_PREFIXES})(?![A-Za-z0-9_])"))
        | (F.regexp_like(n, F.lit("[요다죠네임음]$")) & (F.length(n) > 5))
        | F.lower(n).isin(FALSE_SPEAKERS)
    )


def plausible_names(names: Column) -> Column:
    """Trimmed names that are neither false speakers nor single letters."""
    trimmed = F.transform(names, trim)
    return F.filter(trimmed, lambda n: present(n) & ~is_false_speaker(n) & ~is_single_letter(n))


def peel_speaker(c: Column) -> Column:
    """struct(speaker, text, turn_mark): strip marks, lift a leading ``Name: ``."""
    plain = trim(F.replace(c, F.lit("\u00a0"), F.lit(" ")))
    marked = F.regexp_like(plain, F.lit("^(?:>>|»)"))
    # Marks may be separated by blanks, so the whole run is removed at once.
    text = trim(F.regexp_replace(plain, f"^(?:(?:>>|»)[{SPACE}]*)+", ""))
    name = trim(
        F.coalesce(
            F.nullif(F.regexp_extract(text, LABELLED, 1), F.lit("")),
            F.regexp_extract(text, LABELLED, 2),
        )
    )
    lifted = (name != "") & (~is_false_speaker(name) | is_single_letter(name))
    return F.struct(
        F.when(lifted, normalize_speaker(name)).alias("speaker"),
        F.when(lifted, trim(F.regexp_extract(text, LABELLED, 3))).otherwise(text).alias("text"),
        (lifted | marked).alias("turn_mark"),
    )


def normalize_speaker(name: Column) -> Column:
    n = trim(name)
    return F.when(
        F.regexp_like(n, F.lit(f"(?i)^speaker[{SPACE}]*[0-9]+$")),
        F.regexp_replace(n, f"[{SPACE}]+", " "),
    ).otherwise(n)


def remap_speaker(raw: Column, names: Column) -> Column:
    """A/B and 'speaker N' index into names; a case-insensitive hit; else a plausible name."""
    t = trim(raw)
    number = F.regexp_extract(t, f"(?i)^speaker[{SPACE}]*([0-9]+)$", 1)
    hit = F.filter(names, lambda n: F.lower(n) == F.lower(t))
    return (
        F.when(~present(t), F.lit(None))
        .when(is_single_letter(t), F.get(names, F.ascii(F.upper(t)) - 65))
        .when(number != "", F.get(names, F.greatest(F.lit(0), number.cast("int") - 1)))
        .when(F.size(hit) > 0, F.get(hit, F.lit(0)))
        .when(~is_false_speaker(t) & ~is_single_letter(t), t)
    )


def speakers_from_summary(summary: Column, limit: int = 6) -> Column:
    names = F.transform(F.regexp_extract_all(summary, F.lit(NAME_LINE), 1), squash)
    kept = F.filter(names, lambda n: (n != "") & ~is_false_speaker(n))
    return F.slice(F.array_distinct(kept), 1, limit)


def looks_like_question(c: Column) -> Column:
    t = trim(c)
    return F.regexp_like(t, F.lit("[?？]$")) | F.regexp_like(t, F.lit(f"(?:{QUESTION_ENDINGS})\\??$"))


# -- languages and search ----------------------------------------------------------------


def lang_matches(code: Column, want: Column) -> Column:
    c, w = F.lower(code), F.lower(want)
    return (
        (c == w)
        | F.startswith(c, F.concat(w, F.lit("-")))
        | F.startswith(w, F.concat(c, F.lit("-")))
    )


def count_literal(text: Column, term: Column) -> Column:
    """Case-insensitive, literal, non-overlapping occurrences; a blank term counts nothing."""
    needle = F.lower(trim(term))
    without = F.replace(F.lower(text), needle, F.lit(""))
    hits = (F.length(F.lower(text)) - F.length(without)) / F.length(needle)
    return F.when(needle == "", F.lit(0)).otherwise(hits).cast("bigint")


def highlight(text: Column, term: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    needle = term.strip()
    if not needle:
        return text
    quoted = "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_replace(text, f"(?iu){quoted}", f"{before}$0{after}")


def word_count(c: Column) -> Column:
    hangul = hangul_count(c)
    latin = F.regexp_count(c, F.lit("[A-Za-z0-9]+(?:['’][A-Za-z0-9]+)*"))
    return F.when(hangul > latin * 3, hangul).otherwise(latin + hangul).cast("bigint")


def strip_noise(c: Column) -> Column:
    return squash(drop_noise_words(c))


def clip_at_boundary(c: Column, limit: int) -> Column:
    head = F.substring(c, 1, limit)
    last_mark = F.length(F.regexp_extract(head, "(?s)^(.*[。.!?\\n])", 1))
    last_space = F.length(F.regexp_extract(head, "(?s)^(.*) ", 1))
    return (
        F.when(F.length(c) <= limit, c)
        .when(last_mark - 1 > limit * 0.55, trim(F.substring(head, F.lit(1), last_mark)))
        .when(last_space > 0, trim(F.substring(head, F.lit(1), last_space)))
        .otherwise(trim(head))
    )


def shorten_point(c: Column, limit: int = 110) -> Column:
    return clip_at_boundary(F.regexp_replace(strip_noise(c), f"^[-*•][{SPACE}]*", ""), limit)


def split_sentences(c: Column) -> Column:
    parts = F.split(
        strip_noise(c),
        f"{MAY_BE_SPACE}(?:(?<=[{SENTENCE_MARKS}])[{SPACE}]+|(?<=(?:니다|까요|세요|죠))[{SPACE}]+)",
    )
    return F.filter(F.transform(parts, trim), lambda s: F.length(s) >= 10)


def is_boilerplate(c: Column) -> Column:
    return F.regexp_like(c, F.lit(f"(?iu){BOILERPLATE}"))


def score_sentence(c: Column, index: Column, total: Column, boilerplate: Column | None = None) -> Column:
    """``boilerplate``: where it is known; found in the sentence otherwise."""
    pos = F.when(total <= 1, 0.5).otherwise(index / (total - 1))
    size = F.length(c)
    return F.round(
        F.when((pos <= 0.12) | (pos >= 0.72), 1.4).otherwise(1.0)
        + F.when(F.regexp_like(c, F.lit(SCORED_QUESTIONS)), 1.6).otherwise(0.0)
        + F.when(F.regexp_like(c, F.lit("[0-9]")), 1.3).otherwise(0.0)
        + F.when(size.between(22, 140), 1.0).otherwise(0.0)
        - F.when(size > 220, 0.8).otherwise(0.0)
        - F.when(is_boilerplate(c) if boilerplate is None else boilerplate, 3.0).otherwise(0.0),
        6,
    )


def language_hint(language: Column, sample: Column) -> Column:
    """ko, en or same: the language a summary is written in."""
    lang = F.lower(language)
    return (
        F.when(F.startswith(lang, F.lit("ko")) | (hangul_count(sample) > 20), "ko")
        .when(F.startswith(lang, F.lit("en")), "en")
        .otherwise("same")
    )


# -- escaping ----------------------------------------------------------------------------


def replace_all(c: Column, *pairs: tuple[str, str]) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escape_vtt(c: Column) -> Column:
    return replace_all(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_html(c: Column) -> Column:
    return replace_all(escape_vtt(c), ('"', "&quot;"), ("'", "&#39;"))


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(c, "[\\\\`*_{}\\[\\]<>#!|]", "\\\\$0")


def safe_filename(title: Column, fallback: str = "transcript") -> Column:
    base = F.regexp_replace(F.coalesce(F.nullif(title, F.lit("")), F.lit(fallback)), "[\\x00-\\x1f]", "")
    base = squash_inner(F.regexp_replace(base, '[<>:"/\\\\|?*]', " "))
    base = F.substring(trim(F.regexp_replace(base, "[. ]+$", "")), 1, 120)
    return F.when(base == "", fallback).otherwise(base)


def squash_inner(c: Column) -> Column:
    return F.regexp_replace(c, f"{MAY_BE_SPACE}[{SPACE}]+", " ")


def label_of(c: Column, labels: dict[str, str], default: Column | str) -> Column:
    out = F
    for key, value in labels.items():
        out = out.when(c == key, value)
    return out.otherwise(lit(default))


# Labels printed in exported documents.
SUMMARY_KINDS = {
    "general": "General", "meeting": "Meeting", "course": "Course", "interview": "Interview",
    "podcast": "Podcast", "ai-conference": "AI conference",
}
KEY_POINT_LABELS = {
    "meeting": "Meeting", "course": "Course", "interview": "Interview", "podcast": "Episode",
}
SOURCE_TYPES = {"transcription": "Transcribed audio", "asr": "Auto-generated"}
TIMESTAMP_QUALITY = {
    "chunk-estimated": "Chunk-estimated (approximate)", "provider": "Provider timing",
    "source": "Source caption timing", "none": "No reliable timing",
}


def summary_kind_label(c: Column) -> Column:
    return label_of(c, SUMMARY_KINDS, "General")


def source_type_label(c: Column) -> Column:
    return label_of(c, SOURCE_TYPES, "Manual")


def timestamp_quality_label(c: Column) -> Column:
    return label_of(c, TIMESTAMP_QUALITY, F.lit(None))


def language_name(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when((low == "ko") | F.startswith(low, F.lit("ko-")), "Korean")
        .when((low == "en") | F.startswith(low, F.lit("en-")), "English")
        .otherwise(c)
    )
