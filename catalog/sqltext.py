"""SQL fragments of the text rules for the twins in DuckDB's dialect (RE2 patterns)."""

from __future__ import annotations

from cuelake.functions import text as T

SP = (
    r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
)
HANGUL = r"[\x{ac00}-\x{d7a3}]"
END = T.SENTENCE_END.replace("'", "''")


def trim(x):
    return f"regexp_replace({x}, '^[{SP}]+|[{SP}]+$', '', 'g')"


def squash(x):
    return trim(f"regexp_replace({x}, '[{SP}]+', ' ', 'g')")


def key(x):
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"


def count(x, pattern):
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def overlap(a, b):
    top = f"least(length({a}), length({b}))"
    floor = f"CASE WHEN {top} >= 12 THEN 4 ELSE 2 END"
    return (
        f"coalesce(list_max(list_filter(range({floor}, {top} + 1), "
        f"lambda n: right({a}, n) = left({b}, n))), 0)"
    )


def join_cue(a, b, ov):
    extra = trim(f"substr({b}, {ov} + 1)")
    opens = f"[{SP}(\\[{{‘“\"''/-]$"
    closes = f"^[{SP}.,!?…。？！)\\]’”''\"/-]"
    return f"""CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a}
      WHEN starts_with({b}, {a}) THEN {b}
      WHEN starts_with({a}, {b}) AND length({b}) < length({a}) THEN {a}
      WHEN {ov} > 0 AND {extra} = '' THEN {a}
      WHEN {ov} > 0 THEN {squash(f"concat({a}, CASE WHEN {a} LIKE '% ' THEN '' ELSE ' ' END, {extra})")}
      WHEN regexp_matches({a}, '{opens}') OR regexp_matches({b}, '{closes}')
        THEN {squash(f"concat({a}, {b})")}
      ELSE {squash(f"concat({a}, ' ', {b})")} END"""


def false_speaker(n):
    words = ", ".join(f"'{w}'" for w in T.FALSE_SPEAKERS)
    return f"""({n} = '' OR length({n}) > 40 OR regexp_matches({n}, '^[0-9]+$')
      OR regexp_matches({n}, '^[A-Za-z]$') OR len(regexp_split_to_array({n}, '[{SP}]+')) > 3
      OR regexp_matches({n}, '(?i)^({T.FALSE_PREFIXES})([^A-Za-z0-9_]|$)')
      OR (regexp_matches({n}, '[요다죠네임음]$') AND length({n}) > 5) OR lower({n}) IN ({words}))"""


def strip_noise(x):
    pattern = f"[{SP}]*[\\[(](?:{T.NOISE_WORDS})[\\])][{SP}]*"
    return squash(f"regexp_replace({x}, '{pattern}', ' ', 'gi')")


def clip(x, limit):
    head = f"left({x}, {limit})"
    mark = f"length(regexp_extract({head}, '(?s)^(.*[。.!?\\n])', 1))"
    blank = f"length(regexp_extract({head}, '(?s)^(.*) ', 1))"
    return f"""CASE WHEN length({x}) <= {limit} THEN {x}
      WHEN {mark} - 1 > {limit * 0.55} THEN {trim(f"left({head}, {mark})")}
      WHEN {blank} > 0 THEN {trim(f"left({head}, {blank})")} ELSE {trim(head)} END"""


def shorten(x, limit=110):
    point = f"regexp_replace({strip_noise(x)}, '^[-*•][{SP}]*', '')"
    return f"(SELECT {clip('p', limit)} FROM (SELECT {point} AS p))"


def boilerplate(x):
    return f"regexp_matches({x}, '(?i){T.BOILERPLATE}')"


def words(x):
    h, l = count(x, HANGUL), count(x, r"[A-Za-z0-9]+(?:[''\x{2019}][A-Za-z0-9]+)*")
    return f"CASE WHEN {h} > 3 * {l} THEN {h} ELSE {h} + {l} END"


def question(x):
    t = trim(x)
    return (
        f"(regexp_matches({t}, '[?？]$') OR regexp_matches({t}, '(?:{T.QUESTION_ENDINGS})\\??$'))"
    )


def pad(x, n=2):
    return f"lpad(({x})::BIGINT::VARCHAR, greatest({n}, length(({x})::BIGINT::VARCHAR))::INT, '0')"


def stamp(ms):
    s = f"greatest(0, ({ms}) // 1000)"
    return (
        f"CASE WHEN {s} >= 3600 THEN concat({s} // 3600, ':', {pad(f'{s} % 3600 // 60')}, ':', "
        f"{pad(f'{s} % 60')}) ELSE concat({s} // 60, ':', {pad(f'{s} % 60')}) END"
    )


def clock(ms, sep=","):
    return (
        f"concat({pad(f'({ms}) // 3600000')}, ':', {pad(f'({ms}) % 3600000 // 60000')}, ':', "
        f"{pad(f'({ms}) % 60000 // 1000')}, '{sep}', {pad(f'({ms}) % 1000', 3)})"
    )


def html(x):
    return (
        f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        f"'\"', '&quot;'), '''', '&#39;')"
    )


def md(x):
    return rf"regexp_replace({x}, '([\\`*_{{}}\[\]<>#!|])', '\\\1', 'g')"


def lang_matches(c, w):
    return (
        f"(lower({c}) = lower({w}) OR starts_with(lower({c}), lower({w}) || '-') "
        f"OR starts_with(lower({w}), lower({c}) || '-'))"
    )
