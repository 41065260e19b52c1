"""Frames, display states and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from catalog.adapters import staged
from catalog.base import query
from catalog.chunking import halves
from cuelake.functions.tables import register_table_functions
from cuelake.operators import frames as M
from cuelake.streaming.ingest import upsert_checkpoints

GRID = M.Grid(margin=1, stride=1, cells=4, shift=1)


@F.pandas_udf(BinaryType())
def _bytes(pixels):
    import numpy as np

    return pixels.map(lambda p: np.asarray(p, dtype=np.uint8).tobytes())


def pixels():
    return F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(v.cast("double") * 200 + 128))).cast("int"))


@staged
def frames(t):
    """Every vector as an 8 x 8 gray frame, shown once or up to four times by its label, so that
    recordings have steady and passing states."""
    shown = F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("label") % 4).cast("bigint")))
    f = t.embeddings.select(
        F.floor(F.col("vec_id") / 50).cast("bigint").alias("media_id"), ((F.col("vec_id") % 50) * 2000).alias("t0"), "label", pixels().alias("p"), shown.alias("k"))
    dark = F.transform("p", lambda x: x * 0)
    f = f.withColumn("p", F.when(F.col("label") == 9, dark).otherwise(F.col("p")))
    return f.select("media_id", (F.col("t0") + F.col("k") * 500).cast("double").alias("t_ms"), F.lit(8).alias("width"), F.lit(8).alias("height"), _bytes("p").alias("pixels"), "p")


PX_SQL = """px AS (SELECT vec_id, label, list_transform(embedding, lambda v: greatest(0, least(255, round(v::DOUBLE * 200 + 128)))::INT) AS p FROM embeddings)"""


# Frames of the SQL twins: every vector shown once or up to four times by its label, dark for label 9.
FRAMES_SQL = PX_SQL + """,
fr AS (SELECT vec_id // 50 AS media_id, ((vec_id % 50) * 2000 + k * 500)::DOUBLE AS t_ms, CASE WHEN label = 9 THEN list_transform(p, lambda v: v * 0) ELSE p END AS p
  FROM (SELECT *, unnest(range(0, label % 4 + 1)) AS k FROM px)),
ft AS (SELECT media_id, t_ms, p, list_avg(p) AS mean, list_var_pop(p) AS var,
  list_sum(list_transform(list_filter(range(0, 64), lambda i: i % 8 > 0 AND i >= 8), lambda i: abs(p[i + 1] - p[i]) + abs(p[i + 1] - p[i - 7]))) / (64 * 2 * 255.0) AS sharp,
  row_number() OVER (PARTITION BY media_id ORDER BY t_ms) AS n FROM fr),
ff AS (SELECT media_id, t_ms, n, p, mean < 9 AND var < 80 AS black, sharp < 0.002 AND var < 30 AS unobservable FROM ft)"""


def compare_sql(a, b):
    """Difference of two frames of the test grid: the best of nine shifts, then the worst of sixteen cells."""
    spot = "(li // 6 + 1) * 8 + li % 6 + 2"
    return f"""list_transform(list_transform(list_transform([{{'p': {a}, 'q': {b}, 'm': list_avg({b}) - list_avg({a})}}],
  lambda la: {{'v': la, 't': list_transform(range(0, 9), lambda ls: list_sum(list_transform(range(0, 36), lambda li: abs(la.p[{spot}] - (la.q[{spot} + (ls // 3 - 1) * 8 + ls % 3 - 1] - la.m)))) / 36 / 255)}}),
  lambda lb: {{'v': lb.v, 'plain': lb.t[5], 'best': list_min(lb.t), 's': CASE WHEN lb.t[5] = list_min(lb.t) THEN 4 ELSE list_position(lb.t, list_min(lb.t)) - 1 END}}),
  lambda lx: {{'overall': lx.best, 'motion': lx.plain > 0.04 AND lx.best < lx.plain * 0.5, 'regional': list_max(list_transform(range(0, 16),
    lambda lc: list_avg(list_transform(list_filter(range(0, 36), lambda li: (li // 6 + 1) // 2 = lc // 4 AND (li % 6 + 1) // 2 = lc % 4),
      lambda li: abs(lx.v.p[{spot}] - (lx.v.q[{spot} + (lx.s // 3 - 1) * 8 + lx.s % 3 - 1] - lx.v.m)))) / 255))}})[1]"""


CHANGED = "({0}.overall > 0.07 OR {0}.regional > 0.045)"
UNSURE = "({0}.overall > 0.025 OR {0}.regional > 0.018 OR {0}.motion)"

# The detector frame by frame, all recordings at once. b is the baseline, w the pending frame.
DECISIONS_SQL = f"""{FRAMES_SQL},
dt AS (SELECT media_id, 0::BIGINT AS n, 0.0::DOUBLE AS t_ms, ''::VARCHAR AS kind, NULL::DOUBLE AS since, false AS motion, NULL::INT[] AS b, NULL::INT[] AS w, 0.0::DOUBLE AS seen, 0 AS c FROM ff GROUP BY media_id
  UNION ALL
  SELECT media_id, n, t_ms, CASE WHEN black THEN 'black' WHEN dark THEN 'unobservable' WHEN same THEN 'same' WHEN fresh OR c2 < 2 THEN 'candidate' ELSE 'stable' END,
    CASE WHEN dark OR same OR fresh THEN t_ms ELSE at2 END, coalesce(same AND NOT dark AND d.motion, false),
    CASE WHEN dark THEN NULL WHEN NOT same AND NOT fresh AND c2 >= 2 THEN p ELSE b END,
    CASE WHEN dark OR same OR (NOT fresh AND c2 >= 2) THEN NULL WHEN again THEN w ELSE p END, at2, CASE WHEN dark OR same OR (NOT fresh AND c2 >= 2) THEN 0 ELSE c2 END
  FROM (SELECT *, CASE WHEN again THEN c + 1 ELSE 1 END AS c2, CASE WHEN again OR dark OR same THEN seen ELSE t_ms END AS at2, b IS NULL AND w IS NULL AND NOT again AS fresh
    FROM (SELECT *, coalesce(d.motion OR NOT ({CHANGED.format("d")} OR {UNSURE.format("d")}), false) AS same, coalesce(NOT {CHANGED.format("e")}, false) AS again
      FROM (SELECT f.media_id, f.n, f.t_ms, f.p, f.black, f.black OR f.unobservable AS dark, dt.b, dt.w, dt.seen, dt.c,
        CASE WHEN dt.b IS NOT NULL THEN {compare_sql("dt.b", "f.p")} END AS d, CASE WHEN dt.w IS NOT NULL THEN {compare_sql("dt.w", "f.p")} END AS e
        FROM dt JOIN ff f ON f.media_id = dt.media_id AND f.n = dt.n + 1))))"""
DECIDED = "SELECT media_id, t_ms, kind, since, motion FROM dt WHERE n > 0"


@query("ag18_frame_features", f"""WITH {PX_SQL}, e AS (SELECT vec_id, p, list_avg(p) AS mean, list_var_pop(p) AS variance,
  list_sum(list_transform(list_filter(range(0, 64), lambda i: i % 8 > 0 AND i >= 8), lambda i: abs(p[i + 1] - p[i]) + abs(p[i + 1] - p[i - 7]))) / (64 * 2 * 255.0) AS s FROM px)
SELECT vec_id, round(mean, 6) AS mean, round(variance, 6) AS variance, round(s, 6)::DOUBLE AS sharpness, mean < 9 AND variance < 80 AS black, s < 0.002 AND variance < 30 AS unobservable FROM e""")
def _(t):
    f = t.embeddings.select("vec_id", _bytes(pixels()).alias("p")).select("vec_id", M.frame_feature("p", F.lit(8), F.lit(8)).alias("f"))
    r = lambda c: F.round(f"f.{c}", 6).alias(c)
    return f.select("vec_id", r("mean"), r("variance"), r("sharpness"), "f.black", "f.unobservable")


@query("mth05_compare_frames", f"""WITH {FRAMES_SQL}, d AS (SELECT a.media_id, b.t_ms, {compare_sql("a.p", "b.p")} AS d FROM ff a JOIN ff b ON b.media_id = a.media_id AND b.n = a.n + 1)
SELECT media_id, t_ms, round(d.overall, 6)::DOUBLE AS overall, round(d.regional, 6)::DOUBLE AS regional, d.motion AS motion, {CHANGED.format("d")} AS changed, {UNSURE.format("d")} AS uncertain FROM d""")
def _(t):
    short = lambda c: F.round(c, 6).alias(c)
    return M.compare_neighbours(frames(t), GRID).select("media_id", "t_ms", short("overall"), short("regional"), "motion", "changed", "uncertain")


@query("mth05_plain_difference", f"""WITH {PX_SQL} SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(p[i] - q[i]))) / (64 * 255.0), 6)::DOUBLE AS d
FROM (SELECT vec_id, p, list_reverse(p) AS q FROM px)""")
def _(t):
    p = t.embeddings.select("vec_id", pixels().alias("p"))
    return p.select("vec_id", F.round(M.plain_difference(F.col("p"), F.reverse("p")), 6).alias("d"))


@staged
def decisions(t):
    return M.detect_decisions(frames(t), GRID)


@query("st01_detect_decisions", f"WITH RECURSIVE {DECISIONS_SQL} {DECIDED}")
def _(t):
    return decisions(t)


def event_decisions(t):
    """Events as decisions of a scan: one recording per user."""
    kind = (
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "black").otherwise("unobservable"))
        .when(F.col("event_type") == "signup", "stable").when(F.col("event_type") == "purchase", "candidate").otherwise("same")
    )
    at = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    d = t.events.select(F.col("user_id").alias("media_id"), at.alias("t_ms"), kind.alias("kind"), (F.col("event_id") % 97 == 0).alias("motion"))
    since = F.when(F.col("kind").isin("candidate", "stable"), F.floor(F.col("t_ms") / 7_200_000) * 7_200_000.0)
    return d.withColumn("since", since).withColumn("motion", F.col("motion") & (F.col("kind") == "same"))


def event_media(t):
    last = F.max(F.unix_millis(F.col("ts").cast("timestamp")))
    return t.events.groupBy(F.col("user_id").alias("media_id")).agg((last + 500).alias("duration_ms")).withColumn("last_changed", F.col("media_id") % 3 == 0)


def scan_sql(most):
    return f"""d AS (SELECT user_id AS media_id, (epoch_us(ts) // 1000)::DOUBLE AS t_ms, event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'black' ELSE 'unobservable' END WHEN 'signup' THEN 'stable' WHEN 'purchase' THEN 'candidate' ELSE 'same' END AS kind FROM events),
s AS (SELECT *, kind = 'same' AND event_id % 97 = 0 AS motion, CASE WHEN kind IN ('candidate', 'stable') THEN floor(t_ms / 7200000) * 7200000 END AS since, kind IN ('black', 'unobservable') AS gap FROM d),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(since) OVER w AS ps, coalesce(lag(t_ms) OVER w, greatest(0, t_ms - 500)) AS before FROM s WINDOW w AS (PARTITION BY media_id ORDER BY t_ms)),
m AS (SELECT *, coalesce(pk = 'candidate', false) AS pending, coalesce(pk = 'candidate' AND ps = since, false) AS again, (before + t_ms) / 2 AS middle FROM l),
o AS (SELECT *, kind = 'same' AND pending AS returns, (kind IN ('candidate', 'stable') AND NOT again) OR (kind = 'same' AND pending) AS opens, kind = 'stable' AND again AS confirms FROM m),
c AS (SELECT *, sum(opens::INT) OVER w AS state_no, max(CASE WHEN opens THEN t_ms END) OVER w AS open_at, max(CASE WHEN gap THEN t_ms END) OVER w AS gap_at FROM o WINDOW w AS (PARTITION BY media_id ORDER BY t_ms)),
r AS (SELECT *, state_no > 0 AND (gap_at IS NULL OR gap_at < open_at) AS active FROM c),
x AS (SELECT media_id, max(t_ms)::BIGINT + 500 AS duration_ms, min(CASE WHEN opens AND state_no > {most} THEN t_ms END) AS over_ms, min(CASE WHEN motion AND active THEN t_ms END) AS moved_ms FROM r GROUP BY 1),
z AS (SELECT media_id, duration_ms, media_id % 3 = 0 AS last_changed, CASE WHEN over_ms <= coalesce(moved_ms, over_ms) THEN 'limit' WHEN moved_ms IS NOT NULL THEN 'motion' END AS reason, least(over_ms, moved_ms) AS stop_ms FROM x),
k AS (SELECT r.* FROM r JOIN z USING (media_id) WHERE stop_ms IS NULL OR t_ms < stop_ms OR (t_ms = stop_ms AND reason = 'motion')),
g AS (SELECT media_id, state_no, min(CASE WHEN opens THEN t_ms END) AS o_t, arg_min(before, t_ms) FILTER (opens) AS o_low, arg_min(kind, t_ms) FILTER (opens) AS o_kind, arg_min(returns, t_ms) FILTER (opens) AS o_returns,
  max(CASE WHEN active AND (opens OR confirms OR kind = 'same') THEN t_ms END) AS seen_ms, arg_min(middle, t_ms) FILTER (gap) AS g_mid, min(CASE WHEN gap THEN t_ms END) AS g_t, arg_min(kind, t_ms) FILTER (gap) AS g_kind, bool_or(confirms) AS confirmed, arg_max(kind, t_ms) AS last_kind FROM k GROUP BY ALL),
n AS (SELECT *, CASE WHEN state_no = 1 AND o_t < 500 THEN 0.0 ELSE (o_low + o_t) / 2 END AS start_ms FROM g),
h AS (SELECT *, lead(start_ms) OVER w AS next_start, lead(o_t) OVER w AS next_t, lead(o_low) OVER w AS next_low, lead(o_returns) OVER w AS next_returns FROM n JOIN z USING (media_id) WINDOW w AS (PARTITION BY media_id ORDER BY state_no)),
v AS (SELECT *, next_t IS NULL AND g_t IS NULL AS open_end, stop_ms IS NULL AND next_t IS NULL AND g_t IS NULL AND last_kind <> 'candidate' AND NOT last_changed AS verified, o_kind = 'candidate' AND NOT confirmed AS uncertain FROM h),
b AS (SELECT *, greatest(start_ms, coalesce(g_mid, next_start, CASE WHEN verified THEN duration_ms::DOUBLE END, seen_ms)) AS end_ms, open_end AND stop_ms IS NULL AND NOT verified AS unverified FROM v WHERE state_no > 0)"""


AUDIT_SQL = f"""WITH {scan_sql(200)} SELECT media_id, g_kind AS kind, g_mid AS start_ms, coalesce(next_start, CASE WHEN stop_ms IS NULL THEN duration_ms END)::DOUBLE AS end_ms FROM v WHERE g_t IS NOT NULL AND coalesce(next_start, CASE WHEN stop_ms IS NULL THEN duration_ms END) > g_mid
UNION ALL SELECT media_id, 'transition', start_ms, next_t FROM b WHERE next_returns
UNION ALL SELECT r.media_id, 'transition', b.start_ms, r.t_ms FROM r JOIN z USING (media_id) JOIN b USING (media_id) WHERE r.t_ms = z.stop_ms AND z.reason = 'limit' AND r.returns AND b.next_t IS NULL AND b.g_t IS NULL
UNION ALL SELECT media_id, 'transition', end_ms, duration_ms::DOUBLE FROM b WHERE unverified"""


@query("st02_display_states", f"""WITH {scan_sql(200)} SELECT media_id, state_no::BIGINT AS state_no, sha256(concat_ws(':', media_id, state_no)) AS state_id, start_ms, end_ms, o_low AS start_low_ms, o_t AS start_high_ms,
  CASE WHEN g_t IS NOT NULL THEN 2 * g_mid - g_t ELSE coalesce(next_low, seen_ms) END AS end_low_ms, coalesce(g_t, next_t, least(duration_ms, seen_ms + CASE WHEN last_kind = 'same' THEN 500 ELSE 0 END)) AS end_high_ms,
  concat_ws(',', 'boundary-uncertain', CASE WHEN uncertain THEN 'dynamic' END, CASE WHEN uncertain OR unverified THEN 'incomplete' END, CASE WHEN open_end AND reason = 'motion' THEN 'region-review' END) AS flags FROM b""")
def _(t):
    return M.display_states(event_decisions(t), event_media(t))[0].withColumn("flags", F.array_join("flags", ","))


@query("st04_scan_audit", AUDIT_SQL)
def _(t):
    return M.display_states(event_decisions(t), event_media(t))[1]


@query("st07_resume_scan", f"WITH RECURSIVE {DECISIONS_SQL} {DECIDED}")
def _(t):
    """Every recording scanned up to a cursor of its own and then from there on."""
    f = frames(t)
    before, states = M.scan_on(f.where(F.col("t_ms") <= (F.col("media_id") * 7_919 % 100_000)), None, GRID)
    after, _ = M.scan_on(f, states, GRID)
    return before.unionByName(after)


def scanned(t):
    """All frames but the last of each recording, and the last ones."""
    last = F.max("t_ms").alias("last_ms")
    marked = M.attach_key_values(frames(t), ["media_id"], M.time_block("t_ms"), frames(t).groupBy("media_id").agg(last))
    return marked.where("t_ms < last_ms").drop("last_ms"), marked.where("t_ms = last_ms").drop("last_ms")


@query("st04_end_changes", f"""WITH RECURSIVE {DECISIONS_SQL},
z AS (SELECT media_id, max(n) AS n FROM ff GROUP BY 1 HAVING max(n) > 1),
l AS (SELECT media_id, f.p, f.black OR f.unobservable AS dark, dt.b, CASE WHEN dt.b IS NOT NULL THEN {compare_sql("dt.b", "f.p")} END AS d
  FROM z JOIN ff f USING (media_id, n) JOIN dt ON dt.media_id = z.media_id AND dt.n = z.n - 1)
SELECT media_id, dark OR b IS NULL OR {CHANGED.format("d")} AS last_changed FROM l""")
def _(t):
    f, finals = scanned(t)
    return M.end_changes(M.scan_on(f, None, GRID)[1], finals, GRID)


@query("st02_frame_states")
def _(t):
    """States of a scan of all frames but the last, which is then compared with what the scan ends on."""
    f, finals = scanned(t)
    d, ends = M.scan_on(f, None, GRID)
    media = finals.select("media_id", (F.col("t_ms") + 500).cast("bigint").alias("duration_ms")).join(M.end_changes(ends, finals, GRID), "media_id")
    return M.display_states(d, media)[0].withColumn("flags", F.array_join("flags", ","))


KIND_SQL = """k AS (SELECT user_id AS media_id, (epoch_us(ts) // 1000)::DOUBLE AS t_ms, CASE event_type WHEN 'error' THEN 'black' WHEN 'signup' THEN 'unobservable' ELSE 'same' END AS kind FROM events),
g AS (SELECT *, kind <> 'same' AS gap, (coalesce(lag(t_ms) OVER w, greatest(0, t_ms - 500)) + t_ms) / 2 AS middle, kind <> 'same' AND coalesce(lag(kind) OVER w, 'same') = 'same' AS first FROM k WINDOW w AS (PARTITION BY media_id ORDER BY t_ms)),
n AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t_ms) AS gap_no FROM g),
r AS (SELECT media_id, gap_no, min(middle) AS start_ms, arg_min(kind, t_ms) AS kind FROM n WHERE gap GROUP BY ALL),
a AS (SELECT media_id, gap_no, min(middle) AS next_ms FROM n WHERE NOT gap AND gap_no > 0 GROUP BY ALL),
d AS (SELECT media_id, max(t_ms)::BIGINT + 500 AS duration_ms FROM k GROUP BY 1),
iv AS (SELECT r.media_id, r.kind, r.start_ms, coalesce(a.next_ms, d.duration_ms)::DOUBLE AS end_ms FROM r LEFT JOIN a USING (media_id, gap_no) JOIN d USING (media_id))"""


def event_kinds(t):
    kind = F.when(F.col("event_type") == "error", "black").when(F.col("event_type") == "signup", "unobservable").otherwise("same")
    return t.events.select(F.col("user_id").alias("media_id"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t_ms"), kind.alias("kind"))


def event_gaps(t):
    k = event_kinds(t)
    m = k.groupBy("media_id").agg((F.max("t_ms").cast("bigint") + 500).alias("duration_ms"))
    return M.gap_intervals(M.mark_gaps(k), m)


@query("st03_gap_intervals", f"WITH {KIND_SQL} SELECT * FROM iv WHERE end_ms > start_ms")
def _(t):
    return event_gaps(t)


@query("wn18_midpoint_starts", f"WITH {KIND_SQL} SELECT media_id, t_ms, middle FROM g WHERE gap")
def _(t):
    return M.mark_gaps(event_kinds(t)).where("gap").select("media_id", "t_ms", "middle")


@query("ag19_audit_coverage", f"WITH {KIND_SQL} SELECT media_id, kind, count(*)::BIGINT AS n, sum(end_ms - start_ms)::DOUBLE AS covered_ms FROM iv WHERE end_ms > start_ms GROUP BY ALL")
def _(t):
    return M.audit_coverage(event_gaps(t))


@query("st06_state_limit", f"""WITH {scan_sql(10)} SELECT media_id, CASE WHEN stop_ms IS NULL THEN 'complete' ELSE 'paused' END AS status, coalesce(stop_ms, duration_ms)::DOUBLE AS cursor_ms, reason, (SELECT count(*) FROM b WHERE b.media_id = z.media_id)::BIGINT AS kept FROM z""")
def _(t):
    states, _audit, status = M.display_states(event_decisions(t), event_media(t), max_states=10)
    return status.join(states.groupBy("media_id").agg(F.count(F.lit(1)).alias("kept")), "media_id", "left").na.fill(0, ["kept"])


@query("st05_refine_boundaries")
def _(t):
    f = frames(t)
    seen = M.ordered_scan(f, ["media_id"], ["t_ms"], M.time_block("t_ms"), [M.Scan("b", "lag", F.struct("t_ms", "pixels"))])
    c = seen.where(F.col("b").isNotNull()).select(
        "media_id", F.col("t_ms").cast("bigint").alias("change_id"), F.col("b.t_ms").cast("bigint").alias("low_ms"), F.col("t_ms").cast("bigint").alias("high_ms"),
        F.col("b.pixels").alias("baseline"), "width", "height", F.lit(100_000).cast("bigint").alias("duration_ms"))
    return M.refine_boundaries(c, f.select("media_id", F.col("t_ms").cast("bigint").alias("t_ms"), "pixels"), GRID)


@staged
def sampled_decisions(t):
    return M.detect_decisions(frames(t).where(F.col("t_ms") % 1000 == 0), GRID)


def brackets(t):
    """A scan of every second frame; where a candidate opens, the bracket since the frame before it,
    with the last confirmed frame as baseline."""
    f = frames(t)
    sampled = f.where(F.col("t_ms") % 1000 == 0)
    d = sampled_decisions(t)
    seen = d.join(sampled, ["media_id", "t_ms"])
    held = F.when(F.col("kind").isin("same", "stable"), F.struct("pixels"))
    known = M.ordered_scan(
        seen, ["media_id"], ["t_ms"], M.time_block("t_ms"), [M.Scan("b", "last_before", held), M.Scan("prev", "lag", F.struct("t_ms", "kind", "since"))])
    opens = (F.col("kind") == "candidate") & ~F.coalesce((F.col("prev.kind") == "candidate") & (F.col("prev.since") == F.col("since")), F.lit(False))
    c = known.where(opens & F.col("b").isNotNull()).select(
        "media_id", F.col("t_ms").cast("bigint").alias("change_id"), F.col("prev.t_ms").alias("low_ms"), F.col("t_ms").alias("high_ms"),
        F.col("b.pixels").alias("baseline"), "width", "height", F.lit(100_000).cast("bigint").alias("duration_ms"))
    return d, c, f


@query("st05_bisect_boundaries", f"""WITH RECURSIVE {DECISIONS_SQL.replace("FROM fr)", "FROM fr WHERE t_ms % 1000 = 0)")},
o AS (SELECT media_id, t_ms, n, kind, since, lag(kind) OVER w AS pk, lag(since) OVER w AS ps, lag(t_ms) OVER w AS low, max(CASE WHEN kind IN ('same', 'stable') THEN n END) OVER (PARTITION BY media_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
  FROM dt WHERE n > 0 WINDOW w AS (PARTITION BY media_id ORDER BY n)),
br AS (SELECT o.media_id, o.t_ms AS change_id, o.low, o.t_ms AS high, f.p AS b FROM o JOIN ff f ON f.media_id = o.media_id AND f.n = o.held WHERE o.kind = 'candidate' AND NOT coalesce(o.pk = 'candidate' AND o.ps = o.since, false)),
bi AS (SELECT media_id, change_id, low, high, b FROM br UNION ALL
  SELECT media_id, change_id, CASE WHEN hit THEN low ELSE (low + high) / 2 END, CASE WHEN hit THEN (low + high) / 2 ELSE high END, b
  FROM (SELECT *, {CHANGED.format("d")} AS hit FROM (SELECT bi.*, {compare_sql("bi.b", "f.p")} AS d FROM bi
    JOIN fr f ON f.media_id = bi.media_id AND f.t_ms = (SELECT max(g.t_ms) FROM fr g WHERE g.media_id = bi.media_id AND g.t_ms <= (bi.low + bi.high) / 2) WHERE bi.high - bi.low > 200)))
SELECT media_id, change_id::BIGINT AS change_id, greatest(0, low - 250)::DOUBLE AS low_ms, least(100000, high + 250)::DOUBLE AS high_ms FROM bi WHERE high - low <= 200""")
def _(t):
    _, c, f = brackets(t)
    return M.bisect_boundaries(c, f, GRID)


@query("st05_refined_states")
def _(t):
    """Display states whose openings were narrowed by bisection."""
    d, c, f = brackets(t)
    narrow = M.bisect_boundaries(c, f, GRID).withColumn("t_ms", F.col("change_id").cast("double"))
    media = d.groupBy("media_id").agg((F.max("t_ms") + 1000).cast("bigint").alias("duration_ms")).withColumn("last_changed", F.lit(True))
    return M.display_states(d, media, step_ms=1000.0, refined=narrow)[0].withColumn("flags", F.array_join("flags", ","))


@query("st08_ingest_checkpoints", """SELECT doc_id AS media_id, count(*)::BIGINT AS chunks FROM documents, (SELECT unnest([0, 1])) WHERE len(list_filter(string_split(regexp_replace(text, '[\\n\\t]', ' ', 'g'), ' '), lambda x: x <> '')) > 1 GROUP BY 1""")
def _(t):
    h = halves(t)
    early, late = h.withColumn("completed_at", F.lit(1)), h.withColumn("completed_at", F.lit(2))
    return upsert_checkpoints(early, late).groupBy("media_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("tk06_representatives", """WITH e AS (SELECT vec_id // 5 AS state_id, vec_id, label, first_value(label) OVER (PARTITION BY vec_id // 5 ORDER BY vec_id) AS least FROM embeddings) SELECT state_id, max(vec_id) AS representative_id FROM e WHERE label >= least GROUP BY 1""")
def _(t):
    e = t.embeddings.select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("state_id"), F.col("vec_id").alias("evidence_id"), F.col("label").alias("sharpness"), F.col("vec_id").alias("ord"))
    return M.representative_evidence(e)


@query("tk04_chronological", "SELECT vec_id // 50 AS media_id, vec_id, (row_number() OVER (PARTITION BY vec_id // 50 ORDER BY label, vec_id) - 1)::BIGINT AS n FROM embeddings")
def _(t):
    e = t.embeddings.select(F.floor(F.col("vec_id") / 50).cast("bigint").alias("media_id"), "vec_id", "label")
    return M.numbered(e, ["media_id"], ["label", "vec_id"], (F.col("label") * (1 << 40) + F.floor(F.col("vec_id") / 65_536)).cast("bigint"), "n").drop("label")


TILES_SQL = """WITH RECURSIVE n AS (SELECT p_partkey AS image_id, 0::BIGINT AS x, 0::BIGINT AS y, (p_size * 400)::BIGINT AS w, trunc(p_retailprice * 4)::BIGINT AS h, 0 AS depth, '' AS path FROM part
  UNION ALL SELECT image_id, CASE WHEN w >= h AND k = 1 THEN x + cut - lap ELSE x END, CASE WHEN w < h AND k = 1 THEN y + cut - lap ELSE y END,
    CASE WHEN w < h THEN w WHEN k = 0 THEN cut + lap ELSE side - cut + lap END, CASE WHEN w >= h THEN h WHEN k = 0 THEN cut + lap ELSE side - cut + lap END, depth + 1, path || k
  FROM (SELECT *, greatest(w, h) AS side, greatest(w, h) // 2 AS cut, least(32, greatest(w, h) // 8) AS lap FROM n
    WHERE depth <= 12 AND NOT (greatest(w, h) <= 8192 AND w * h <= 16777216 AND w * h * 0.2::DOUBLE <= 3000000) AND NOT (w < 96 AND h < 96)), (SELECT unnest([0, 1]) AS k)),
l AS (SELECT *, greatest(w, h) <= 8192 AND w * h <= 16777216 AND w * h * 0.2::DOUBLE <= 3000000 AS fits FROM n),
r AS (SELECT image_id, bool_or(depth > 12 OR (NOT fits AND w < 96 AND h < 96)) OR count(*) FILTER (fits) > 200 AS refused FROM l GROUP BY 1)
SELECT image_id, false AS refused, (row_number() OVER (PARTITION BY image_id ORDER BY path) - 1)::INT AS tile, x::INT AS x, y::INT AS y, w::INT AS width, h::INT AS height FROM l JOIN r USING (image_id) WHERE fits AND NOT refused
UNION ALL SELECT image_id, true, NULL, NULL, NULL, NULL, NULL FROM r WHERE refused"""


def images(t):
    return t.part.select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 400).alias("width"), (F.col("p_retailprice") * 4).cast("int").alias("height"), F.lit(0.2).cast("double").alias("bytes_per_pixel"))


@query("arr04_tile_plan", TILES_SQL)
def _(t):
    return M.tile_plan(images(t))


@query("udtf01_image_tiles", TILES_SQL)
def _(t):
    """The same plan by the table function that takes a whole table, partitioned by image."""
    register_table_functions(t.spark)
    return t.spark.sql("SELECT * FROM image_tiles(TABLE({images}))", images=images(t))


@query("udf01_apply_provider", "SELECT doc_id, length(text)::BIGINT AS size, upper(lang) AS lang FROM documents")
def _(t):
    def provide(pdf):
        return pdf.assign(size=pdf["text"].str.len().astype("int64"), lang=pdf["lang"].str.upper())[["doc_id", "size", "lang"]]

    return M.apply_provider(t.documents.select("doc_id", "text", "lang"), provide, "doc_id BIGINT, size BIGINT, lang STRING")
