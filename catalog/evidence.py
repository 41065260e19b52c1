"""Ledger, slide text and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import sqltext as S
from catalog.adapters import staged
from catalog.base import query
from cuelake.functions import cost as M
from cuelake.functions.arrays import overlay_map
from cuelake.functions.checks import valid_corners
from cuelake.operators import joins as J
from cuelake.operators import ledger as L
from cuelake.operators import slides as D
from cuelake.operators.ordered import numbered
from cuelake.sinks.documents import document_parts

# -- attempts from order lines -----------------------------------------------------------

_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@staged
def attempts(t):
    return attempt_rows(numbered(t.lineitem, ["l_orderkey"], _ORDER, F.floor(F.col("l_partkey") / 1000).cast("bigint"), "ord", few_busy=True))


def attempt_rows(li):
    """Order lines as attempts; ``ord`` is their number in the order."""
    rf = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("job_id"), F.col("ord").cast("bigint").alias("ord"), (F.col("l_partkey") % 50).alias("op_key"),
        F.col("l_suppkey").alias("crop_id"), F.concat("l_orderkey", F.lit("-"), "ord").alias("attempt_id"),
        F.when(rf == "A", "completed").when(rf == "N", "failed").otherwise("unknown-billing").alias("outcome"),
        F.when(rf == "A", "known").when(rf == "N", "none").otherwise("unknown").alias("billing"),
        F.when((rf == "A") & (F.col("l_linenumber") != 3), F.round(F.col("l_quantity") / 1000, 6)).alias("cost_usd"),
        (F.col("l_extendedprice") / 1_000_000).alias("reserved_usd"),
        F.when(F.col("l_linestatus") == "F", F.lit("x")).alias("reused_from"),
        (F.col("l_linenumber") != 5).alias("has_extraction"), (F.col("l_tax") < 0.04).alias("retryable"),
        F.col("l_quantity").cast("bigint").alias("q"),
    )


ATT_SQL = f"""att AS (SELECT l_orderkey AS job_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) - 1)::BIGINT AS ord, l_partkey % 50 AS op_key, l_suppkey AS crop_id,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'failed' ELSE 'unknown-billing' END AS outcome, CASE l_returnflag WHEN 'A' THEN 'known' WHEN 'N' THEN 'none' ELSE 'unknown' END AS billing,
  CASE WHEN l_returnflag = 'A' AND l_linenumber <> 3 THEN round(l_quantity / 1000, 6) END AS cost, l_extendedprice / 1000000 AS res, l_linestatus <> 'F' AS paid,
  l_linenumber <> 5 AS has_x, l_tax < 0.04 AS retryable, l_quantity::BIGINT AS q FROM lineitem)"""


def _f(c):
    return F.round(F.col(c).cast("double"), 8).alias(c)


@query("ag01_ledger_totals", f"""WITH {ATT_SQL} SELECT job_id, round(sum(CASE WHEN paid THEN coalesce(cost, 0) ELSE 0 END::DECIMAL(28,9))::DOUBLE, 8) AS known,
  round(sum(CASE WHEN paid AND (billing = 'unknown' OR outcome = 'completed') AND cost IS NULL THEN res ELSE 0 END::DECIMAL(28,9))::DOUBLE, 8) AS reserve,
  count(*) FILTER (billing = 'unknown')::BIGINT AS unknown_billing, count(*) FILTER (paid)::BIGINT AS requests FROM att GROUP BY 1""")
def _(t):
    return L.ledger_totals(attempt_rows(t.lineitem.withColumn("ord", F.lit(None)))).select("job_id", _f("known"), _f("reserve"), "unknown_billing", "requests")


@query("ag05_request_limits", f"""WITH {ATT_SQL} SELECT job_id, count(*) FILTER (paid)::BIGINT AS requests, count(*) FILTER (paid) >= 3 AS reached FROM att GROUP BY 1""")
def _(t):
    # totals need no numbers of attempts
    return L.ledger_totals(attempt_rows(t.lineitem.withColumn("ord", F.lit(None)))).select("job_id", "requests", (F.col("requests") >= 3).alias("reached"))


@query("jn09_content_reuse", f"""WITH {ATT_SQL} SELECT job_id, op_key, concat(job_id, '-', max(ord)) AS reuse_of FROM att WHERE outcome = 'completed' AND has_x GROUP BY job_id, op_key""")
def _(t):
    return L.reusable(attempts(t))


@query("wn15_first_payers", f"""WITH {ATT_SQL} SELECT job_id, ord, op_key, row_number() OVER (PARTITION BY job_id, op_key ORDER BY ord) = 1 AS pays FROM att""")
def _(t):
    return L.first_payers(attempts(t)).select("job_id", "ord", "op_key", "pays")


def operations(t):
    return attempts(t).select("job_id", "ord", (F.col("op_key") % 3).alias("op_key"), F.col("reserved_usd").alias("estimate"))


def budgets(t):
    return t.orders.select(
        F.col("o_orderkey").alias("job_id"), F.round(F.col("o_totalprice") / 2_000_000, 9).alias("budget_usd"), F.lit(4).alias("max_requests")
    )


@query("wn11_budget_prefix", f"""WITH {ATT_SQL}, b AS (SELECT o_orderkey AS job_id, round(o_totalprice / 2000000, 9)::DECIMAL(28,9) AS b FROM orders),
r AS (SELECT a.job_id, a.ord, b.b, sum(a.res::DECIMAL(28,9)) OVER (PARTITION BY a.job_id ORDER BY a.ord) AS spent FROM att a JOIN b USING (job_id))
SELECT job_id, ord, round(spent::DOUBLE, 8) AS spent FROM r WHERE spent <= b""")
def _(t):
    return L.budget_prefix(operations(t), budgets(t)).select("job_id", "ord", _f("spent"))


@query("ag04_pending_estimate", f"""WITH {ATT_SQL}, f AS (SELECT job_id, op_key % 3 AS k, arg_min(res, ord) AS e FROM att GROUP BY ALL),
d AS (SELECT DISTINCT job_id, op_key AS k FROM att WHERE outcome = 'completed' AND has_x)
SELECT job_id, round(sum(e::DECIMAL(28,9))::DOUBLE, 8) AS pending FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.job_id = f.job_id AND d.k = f.k) GROUP BY 1""")
def _(t):
    return L.pending_estimate(operations(t), attempts(t)).select("job_id", _f("pending"))


@query("plan_extraction_decisions", f"""WITH {ATT_SQL},
tot AS (SELECT job_id, sum(CASE WHEN paid THEN coalesce(cost, 0) ELSE 0 END::DECIMAL(28,9)) AS known, sum(CASE WHEN paid AND (billing = 'unknown' OR outcome = 'completed') AND cost IS NULL THEN res ELSE 0 END::DECIMAL(28,9)) AS reserve,
  count(*) FILTER (paid) AS reqs FROM att GROUP BY 1),
reu AS (SELECT DISTINCT job_id, op_key FROM att WHERE outcome = 'completed' AND has_x), uns AS (SELECT DISTINCT job_id, op_key FROM att WHERE billing = 'unknown'),
op AS (SELECT job_id, ord, op_key % 3 AS op_key, res::DECIMAL(28,9) AS est, q FROM att),
k AS (SELECT op.*, row_number() OVER (PARTITION BY op.job_id, op.op_key ORDER BY ord) = 1 AND reu.job_id IS NULL AS pays FROM op LEFT JOIN reu ON reu.job_id = op.job_id AND reu.op_key = op.op_key),
pen AS (SELECT job_id, sum(est) AS pending FROM k WHERE pays GROUP BY 1),
s AS (SELECT o_orderkey AS job_id, round(o_totalprice / 2000000, 9)::DECIMAL(28,9) AS budget, coalesce(known, 0) AS known, coalesce(reserve, 0) AS reserve, coalesce(pending, 0) AS pending, coalesce(reqs, 0) AS reqs
  FROM orders LEFT JOIN tot ON tot.job_id = o_orderkey LEFT JOIN pen ON pen.job_id = o_orderkey),
r AS (SELECT k.*, s.*, uns.job_id IS NOT NULL AS unsettled, sum(CASE WHEN pays THEN est ELSE 0 END) OVER w AS spent, sum(CASE WHEN pays THEN 1 ELSE 0 END) OVER w AS sent
  FROM k LEFT JOIN s ON s.job_id = k.job_id LEFT JOIN uns ON uns.job_id = k.job_id AND uns.op_key = k.op_key WINDOW w AS (PARTITION BY k.job_id ORDER BY ord)),
m AS (SELECT *, CASE WHEN known + reserve + pending > budget THEN 'over_budget_plan' WHEN q > 45 THEN 'needs_approval' WHEN pays AND unsettled THEN 'unknown_billing'
  WHEN pays AND known + reserve + spent > budget THEN 'over_budget' WHEN pays AND reqs + sent > 4 THEN 'request_limit' END AS stop FROM r),
c AS (SELECT job_id, min(ord) AS cut FROM m WHERE stop IS NOT NULL GROUP BY 1)
SELECT m.job_id, m.ord, m.op_key, CASE WHEN (c.cut IS NULL OR m.ord < c.cut) THEN CASE WHEN pays THEN 'pay' ELSE 'reuse' END WHEN m.ord = c.cut THEN stop ELSE 'paused' END AS decision
FROM m LEFT JOIN c ON c.job_id = m.job_id""")
def _(t):
    ok = attempts(t).where(F.col("q") <= 45).select("job_id", "ord")
    return L.plan_extraction(operations(t), attempts(t), budgets(t), ok)


@query("wn16_retry_audit", f"""WITH {ATT_SQL}, p AS (SELECT *, row_number() OVER w AS n, lag(retryable AND billing = 'none') OVER w AS fair FROM (SELECT * FROM att WHERE paid) WINDOW w AS (PARTITION BY job_id, op_key ORDER BY ord))
SELECT job_id, op_key, ord, n::BIGINT AS "try", n = 1 OR (coalesce(fair, false) AND n <= 2) AS allowed FROM p""")
def _(t):
    return L.retry_audit(attempts(t).withColumn("crop_id", F.lit(0))).drop("crop_id")


@query("st09_current_attempts", f"""WITH {ATT_SQL} SELECT concat(job_id, '-', ord) AS attempt_id, outcome FROM att""")
def _(t):
    a = attempts(t)
    log = a.select("attempt_id", F.lit(0).alias("log_ord"), F.lit("unknown-billing").alias("outcome")).unionByName(
        a.select("attempt_id", F.lit(1).alias("log_ord"), "outcome"))
    return L.current_attempts(log).select("attempt_id", "outcome")


# -- costs -------------------------------------------------------------------------------

_RATE = "CASE l_returnflag WHEN 'A' THEN {a} ELSE {b} END"


def priced(t):
    li = t.lineitem.withColumn("profile", F.when(F.col("l_returnflag") == "A", "standard").otherwise("economy"))
    return li.join(F.broadcast(M.default_pricing(t.spark)), "profile")


def _r(a, b):
    return _RATE.format(a=a, b=b)


@query("mth01_usage_cost", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(((i - c - w) * {_r(2, 0.1)} + c * {_r(0.1, 0.01)} + w * {_r(2.5, 0.125)} + l_quantity * 10 * {_r(10, 0.5)}) / 1000000, 9) AS cost
FROM (SELECT *, least(i - c, l_linenumber * 50) AS w FROM (SELECT *, l_quantity * 100 AS i, least(l_quantity * 100, l_suppkey * 10) AS c FROM lineitem))""")
def _(t):
    q = F.col("l_quantity")
    c = M.usage_cost(q * 100, q * 10, F.col("l_suppkey") * 10, F.col("l_linenumber") * 50, *[F.col(x) for x in ("input", "output", "cached_input", "cache_write")])
    return priced(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(c, 9).alias("cost"))


@query("mth02_hypothetical_cost", f"""SELECT l_returnflag, count(*)::BIGINT AS calls, round(count(*) * (3000 * {_r(2, 0.1)} + 1000 * {_r(10, 0.5)}) / 1000000 * 1.25, 6)::DOUBLE AS cost FROM lineitem GROUP BY 1""")
def _(t):
    g = priced(t).groupBy("l_returnflag", "input", "output").agg(F.count(F.lit(1)).alias("calls"))
    c = M.hypothetical_cost(F.col("calls"), F.lit(3000), F.lit(1000), F.col("input"), F.col("output"), F.lit(0.25))
    return g.select("l_returnflag", "calls", F.round(c, 6).alias("cost"))


@query("mth03_operation_estimate", f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(((1500 + ceil(l_quantity * 40 * (500 + l_suppkey) / 1000000 * 3000)) * {_r(2, 0.1)} + least(4096, 8192) * {_r(10, 0.5)}) / 1000000 * 1.25, 9) AS estimate FROM lineitem""")
def _(t):
    e = M.operation_estimate(F.col("l_quantity") * 40, F.lit(500) + F.col("l_suppkey"), F.lit(3000), F.lit(4096), F.col("max_output_tokens"), F.col("input"), F.col("output"), F.lit(0.25))
    return priced(t).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(e, 9).alias("estimate"))


@query("ag12_asset_admission", """WITH a AS (SELECT doc_id % 3 AS store_id, (row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1)::BIGINT AS ord, n_chars * 500 AS b FROM documents),
r AS (SELECT *, b BETWEEN 1 AND 32000000 AS fits, sum(CASE WHEN b BETWEEN 1 AND 32000000 THEN b ELSE 0 END) OVER (PARTITION BY store_id ORDER BY ord)::BIGINT AS total FROM a)
SELECT store_id, ord, total, CASE WHEN NOT fits THEN 'bad_size' WHEN total > 128000000 THEN 'storage_quota' ELSE 'ok' END AS admission FROM r""")
def _(t):
    a = t.documents.select((F.col("doc_id") % 3).alias("store_id"), "doc_id", (F.col("n_chars") * 500).alias("size_bytes"))
    return L.asset_admission(numbered(a, ["store_id"], ["doc_id"], F.floor(F.col("doc_id") / 65_536).cast("bigint"), "ord"))


@query("jsn01_operation_keys", """SELECT count(*)::BIGINT AS n_rows, count(DISTINCT (l_partkey, l_quantity, l_linenumber))::BIGINT AS keys FROM lineitem""")
def _(t):
    k = t.lineitem.select(L.operation_key(["l_partkey", "l_quantity"], ["l_linenumber"], [], ("p1", "s1")).alias("k"))
    g = k.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("keys"))


# -- slide text from documents: one state per document, two attempts per crop -------------


def states(t):
    return t.documents.select(
        F.col("doc_id").alias("state_id"), F.floor(F.col("doc_id") / 50).cast("bigint").alias("media_id"),
        ((F.col("doc_id") % 50) * 3000).alias("start_ms"), ((F.col("doc_id") % 50) * 3000 + 2500).alias("end_ms"),
        F.when(F.col("source") == "src2", "excluded").otherwise("pending").alias("status"),
        F.concat(F.lit("e"), "doc_id").alias("representative_id"), (F.col("doc_id") % 50).alias("ord"))


def crops(t):
    d = t.documents.select(F.col("doc_id").alias("state_id"), F.explode(F.array(F.lit("e"), F.lit("x"))).alias("p"))
    return d.select("state_id", F.concat("p", "state_id").alias("evidence_id"), F.concat("p", "state_id", F.lit("-0")).alias("id"), F.lit(0).alias("pos"))


def slide_attempts(t):
    none = F.array().cast("array<array<string>>")
    block = lambda kind, text, rows=none: F.struct(F.lit(kind).alias("type"), text.alias("text"), rows.alias("rows"))
    rows = F.array(F.array(F.lit("a|b"), F.col("source")), F.array(F.col("lang"), F.lit("x\ny")))
    real = F.array(
        block("heading", F.concat(F.lit("Doc "), "doc_id")), block("paragraph", F.col("text")), block("table", F.lit(""), rows),
        block("code", F.concat(F.lit("a ``` b "), "lang")))
    empty = F.array().cast("array<struct<type: string, text: string, rows: array<array<string>>>>")
    x = F.struct(
        F.when(F.col("lang") == "es", "textless").otherwise("text").alias("status"), F.when(F.col("lang") == "es", empty).otherwise(real).alias("blocks"))
    old = F.struct(F.lit("text").alias("status"), F.array(block("paragraph", F.lit("old"))).alias("blocks"))
    one = lambda i, e, outcome: F.struct(F.lit(i).alias("ord"), F.lit(f"a{i}").alias("attempt_id"), outcome.alias("outcome"), e.alias("extraction"))
    both = F.array(one(0, old, F.lit("completed")), one(1, x, F.when(F.col("lang") == "fr", "failed").otherwise("completed")))
    return t.documents.where(F.col("source") != "src9").select(
        F.col("doc_id").alias("state_id"), F.concat(F.lit("e"), "doc_id", F.lit("-0")).alias("crop_id"), F.explode(both).alias("a")
    ).select("state_id", "crop_id", "a.*")


def accepted(t):
    return t.documents.where(F.col("source") == "src8").select(
        F.col("doc_id").alias("state_id"), F.concat(F.lit("e"), "doc_id", F.lit("-0")).alias("crop_id"), F.lit("a0").alias("attempt_id"))


def block_edits(t):
    return t.documents.where(F.col("source") == "src1").select(
        F.col("doc_id").alias("state_id"), F.concat(F.lit("e"), "doc_id", F.lit("-0:0")).alias("block_key"), F.lit("Edited *title*").alias("edited"))


def chosen(t):
    return D.accepted_attempts(D.representative_crops(states(t), crops(t)), slide_attempts(t), accepted(t))


def blocks(t):
    return D.state_blocks(chosen(t), block_edits(t))


_KIND = "CASE WHEN source = 'src9' THEN 'none' WHEN source = 'src8' OR lang = 'fr' THEN 'old' WHEN lang = 'es' THEN 'textless' ELSE 'new' END"


@query("jn11_representative_crops", "SELECT doc_id AS state_id, 'e' || doc_id AS evidence_id, 'e' || doc_id || '-0' AS id, 0 AS pos FROM documents")
def _(t):
    return D.representative_crops(states(t), crops(t))


@query("jn10_accepted_attempts", f"SELECT doc_id AS state_id, 'e' || doc_id || '-0' AS crop_id, CASE {_KIND} WHEN 'none' THEN NULL WHEN 'old' THEN 'a0' ELSE 'a1' END AS attempt_id FROM documents")
def _(t):
    return chosen(t).select("state_id", "crop_id", "attempt_id")


@query("jn16_block_edits", f"""SELECT doc_id AS state_id, 'e' || doc_id || '-0:0' AS block_key, 'Edited *title*' AS edited FROM documents WHERE source = 'src1' AND {_KIND} IN ('old', 'new')""")
def _(t):
    return blocks(t).where(F.col("edited").isNotNull()).select("state_id", "block_key", "edited")


def _slide_sql(md: bool) -> str:
    esc = S.md if md else (lambda x: x)
    table = (
        f"concat('| ', {S.md(chr(39) + 'a|b' + chr(39))}, ' | ', {S.md('source')}, ' |', chr(10), '| --- | --- |', chr(10), '| ', {S.md('lang')}, ' | x<br>y |')"
        if md else "concat('a|b', chr(9), source, chr(10), lang, chr(9), 'x', chr(10), 'y')"
    )
    code = "concat('````', chr(10), 'a ``` b ', lang, chr(10), '````')" if md else "concat('a ``` b ', lang)"
    title = "CASE WHEN source = 'src1' THEN 'Edited *title*' ELSE 'Doc ' || doc_id END"
    label = (
        f"concat('[', {S.clock('(doc_id % 50) * 3000', '.')}, ' – ', {S.clock('(doc_id % 50) * 3000 + 2500', '.')}, '] Slide ', lpad(n::VARCHAR, 3, '0'), ' — ', "
        f"CASE WHEN kind = 'new' THEN {title} ELSE '{D.UNTITLED}' END)"
    )
    old = "CASE WHEN source = 'src1' THEN 'Edited *title*' ELSE 'old' END"
    return f"""WITH s AS (SELECT *, {_KIND} AS kind, doc_id // 50 AS media_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS n FROM documents WHERE source <> 'src2'),
c AS (SELECT media_id, doc_id, concat({"'### ', " + S.md(label) if md else label}, chr(10), CASE kind WHEN 'new' THEN concat({esc(title)}, chr(10), chr(10), {esc('text')}, chr(10), chr(10), {table}, chr(10), chr(10), {code})
  WHEN 'old' THEN {esc(old)} ELSE '' END, CASE kind WHEN 'none' THEN chr(10) || '{D.PENDING}' WHEN 'textless' THEN chr(10) || '{D.TEXTLESS}' ELSE '' END) AS chunk FROM s)
SELECT media_id, 0::BIGINT AS part, string_agg(chunk, chr(10) || chr(10) ORDER BY doc_id) AS text FROM c GROUP BY 1"""


@query("snk08_export_slides_txt", _slide_sql(False))
def _(t):
    return document_parts(D.export_slides(states(t), chosen(t), blocks(t)))


@query("snk08_export_slides_markdown", _slide_sql(True))
def _(t):
    return document_parts(D.export_slides(states(t), chosen(t), blocks(t), markdown=True))


@query("str25_markdown_blocks", f"""SELECT doc_id AS state_id, concat('| ', {S.md("'a|b'")}, ' | ', {S.md('source')}, ' |', chr(10), '| --- | --- |', chr(10), '| ', {S.md('lang')}, ' | x<br>y |') AS md,
  concat('a|b', chr(9), source, chr(10), lang, chr(9), 'x', chr(10), 'y') AS plain FROM documents WHERE {_KIND} = 'new'""")
def _(t):
    return blocks(t).where(F.col("block.type") == "table").select(
        "state_id", D.markdown_block(F.col("block"), F.col("edited")).alias("md"), D.literal_block(F.col("block")).alias("plain"))


@query("flt06_block_search", f"""SELECT doc_id AS state_id, 'e' || doc_id || '-0:1' AS block_key FROM documents WHERE {_KIND} = 'new' AND contains(lower(text), 'tion')""")
def _(t):
    return D.search_blocks(blocks(t), "TION").select("state_id", "block_key")


@query("flt18_eligible_states", "SELECT doc_id AS state_id FROM documents WHERE source <> 'src2'")
def _(t):
    return D.eligible_states(states(t)).select("state_id")


@query("jn15_approved_prefix", """SELECT doc_id AS state_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id // 50 = d.doc_id // 50 AND b.doc_id <= d.doc_id AND b.source = 'src5')""")
def _(t):
    ok = t.documents.where(F.col("source") != "src5").select(F.col("doc_id").alias("state_id"))
    return D.approved_prefix(states(t), ok).select("state_id")


@query("ag13_selected_totals", """SELECT doc_id // 50 AS media_id, count(*)::BIGINT AS crops, round(sum((1500 + ceil(n_chars * 1000 / 1000000 * 3000)) * 2 + 4096 * 10) / 1000000 * 1.25, 4)::DOUBLE AS estimate FROM documents WHERE source <> 'src2' GROUP BY 1""")
def _(t):
    c = D.representative_crops(D.eligible_states(states(t)), crops(t)).join(
        t.documents.select(F.col("doc_id").alias("state_id"), "n_chars"), "state_id")
    e = M.operation_estimate(F.col("n_chars"), F.lit(1000), F.lit(3000), F.lit(4096), F.lit(8192), F.lit(2.0), F.lit(10.0), F.lit(0.25))
    rows = c.select(F.floor(F.col("state_id") / 50).cast("bigint").alias("media_id"), L.money(e).alias("estimate"))
    return D.selected_totals(rows).withColumn("estimate", F.round(F.col("estimate").cast("double"), 4))


@query("ag14_completion_status", """SELECT doc_id // 50 AS media_id, CASE WHEN min(doc_id) % 100 = 0 AND bool_and(source <> 'src5') THEN 'completed' ELSE 'review' END AS status FROM documents GROUP BY 1""")
def _(t):
    s = states(t).withColumn("status", F.when(F.col("state_id").isin(-1), "x").otherwise(F.lit("completed")))
    src = t.documents.select(F.col("doc_id").alias("state_id"), "source")
    s = s.join(src, "state_id").withColumn("status", F.when(F.col("source") == "src5", "pending").otherwise("completed"))
    scans = states(t).groupBy("media_id").agg((F.min("state_id") % 100 == 0).alias("scan_complete"))
    return L.completion_status(s, scans)


@query("so07_exclusion_audit", """SELECT doc_id // 50 AS media_id, 'excluded:' || doc_id AS id, (doc_id % 50) * 3000 AS start_ms, (doc_id % 50) * 3000 + 2500 AS end_ms, 'excluded' AS kind FROM documents WHERE source IN ('src3', 'src4')""")
def _(t):
    drop = t.documents.where(F.col("source").isin("src3", "src4")).select(F.col("doc_id").alias("state_id"))
    old = states(t).join(t.documents.where(F.col("source") == "src4").select(F.col("doc_id").alias("state_id")), "state_id").select(
        "media_id", F.concat(F.lit("excluded:"), "state_id").alias("id"), "start_ms", "end_ms", F.lit("excluded").alias("kind"))
    return D.exclude_states(states(t), old, drop)[1]


@query("so06_flag_sets", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'boundary-uncertain,unreadable' ELSE 'boundary-uncertain,' || source || ',unreadable' END AS flags FROM documents""")
def _(t):
    have = F.array(F.lit("boundary-uncertain"), F.when(F.col("lang") == "en", "incomplete").otherwise(F.col("source")), F.lit("dynamic"))
    out = D.update_flags(have, F.array(F.lit("unreadable"), F.lit("dynamic")), F.array(F.lit("incomplete"), F.lit("dynamic")))
    return t.documents.select("doc_id", F.array_join(out, ",").alias("flags"))


@query("map01_edit_maps", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS value, 2 AS n FROM documents""")
def _(t):
    base = F.create_map(F.lit("k"), F.lit("old"), F.lit("j"), F.col("source"))
    over = F.when(F.col("lang") == "en", F.create_map(F.lit("k"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = overlay_map(base, over)
    return t.documents.select("doc_id", F.element_at(merged, "k").alias("value"), F.size(merged).alias("n"))


# -- crops, regions ----------------------------------------------------------------------


def rectangles(t, shift):
    return t.documents.where(F.col("source") != shift).select(
        (F.floor(F.col("doc_id") / 4)).cast("bigint").alias("evidence_id"), (F.col("doc_id") % 4).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("width"),
        F.lit(20).alias("height"), F.lit(100).alias("full_width"), F.lit(100).alias("full_height"),
        F.md5(F.when(F.col("source") == "src2", F.lit(shift)).otherwise(F.col("text")).cast("binary")).alias("hash"))


@query("jn12_evidence_mismatches", """WITH a AS (SELECT doc_id // 4 AS e, doc_id % 4 AS x, CASE WHEN source = 'src2' THEN 'src0' ELSE text END AS h FROM documents WHERE source <> 'src0'),
b AS (SELECT doc_id // 4 AS e, doc_id % 4 AS x, CASE WHEN source = 'src2' THEN 'src1' ELSE text END AS h FROM documents WHERE source <> 'src1'),
j AS (SELECT coalesce(a.e, b.e) AS e, a.x AS ax, b.x AS bx FROM a FULL OUTER JOIN b ON a.e = b.e AND a.x = b.x AND a.h = b.h)
SELECT e AS evidence_id, count(ax)::BIGINT AS stored, count(bx)::BIGINT AS fresh, count(*) FILTER (bx IS NULL)::BIGINT AS missing, count(*) FILTER (ax IS NULL)::BIGINT AS unexpected,
  count(*) FILTER (bx IS NULL) > 0 OR count(ax) <> count(bx) AS mismatch FROM j GROUP BY 1""")
def _(t):
    return J.evidence_mismatches(rectangles(t, "src0"), rectangles(t, "src1"))


def regions(t):
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    v = F.least(F.lit(1.0), F.col("value") / 400)
    base = t.events.select(
        F.col("user_id").alias("media_id"), "event_id", F.col("value"), (F.unix_millis(F.col("ts").cast("timestamp")) % 7_200_000).alias("time_ms"),
        F.array(p(F.lit(0.0), F.lit(0.0)), p(v, F.lit(0.0)), p(v, F.lit(1.0)), p(F.lit(0.0), F.lit(1.0))).alias("corners"))
    return base.withColumn("pos", F.col("event_id"))


@query("flt16_valid_corners", "SELECT event_id, least(1.0, value / 400) > 0.0001 AS valid FROM events")
def _(t):
    return regions(t).select("event_id", valid_corners(F.col("corners")).alias("valid"))


@query("mth04_region_dimensions", "SELECT event_id, greatest(1, round(least(1.0, value / 400) * 1280))::BIGINT AS width, 720::BIGINT AS height FROM events")
def _(t):
    w, h = D.region_dimensions(F.col("corners"), F.lit(1280), F.lit(720))
    return regions(t).select("event_id", w.alias("width"), h.alias("height"))


@query("jn02_region_at", """WITH r AS (SELECT user_id AS media_id, event_id AS pos, (epoch_us(ts) // 1000) % 7200000 AS time_ms FROM events),
f AS (SELECT DISTINCT media_id, unnest(range(0, 7200000, 60000))::BIGINT AS t_ms FROM r),
l AS (SELECT f.media_id, f.t_ms, (SELECT arg_max(r.pos, r.time_ms * 10000000 + r.pos) FROM r WHERE r.media_id = f.media_id AND r.time_ms <= f.t_ms) AS p FROM f)
SELECT media_id, t_ms, coalesce(p, (SELECT min(pos) FROM r WHERE r.media_id = l.media_id)) AS pos FROM l""")
def _(t):
    r = regions(t).select("media_id", "pos", "time_ms", "corners")
    f = r.select("media_id").distinct().select("media_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7_140_000).cast("bigint"), F.lit(60_000).cast("bigint"))).alias("t_ms"))
    return J.region_at(f, r).select("media_id", "t_ms", F.col("region.pos").alias("pos"))


@query("so05_upsert_regions", """WITH r AS (SELECT user_id AS media_id, event_id, event_type, (epoch_us(ts) // 1000) % 7200000 AS time_ms FROM events),
n AS (SELECT DISTINCT media_id, time_ms FROM r WHERE event_type = 'click'), o AS (SELECT media_id, time_ms FROM r WHERE event_type <> 'click'),
k AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.media_id = o.media_id AND abs(n.time_ms - o.time_ms) <= 50))
SELECT media_id, time_ms, count(*)::BIGINT AS n FROM (SELECT * FROM k UNION ALL SELECT * FROM n) GROUP BY ALL""")
def _(t):
    e = t.events.select(F.col("user_id").alias("media_id"), "event_type", (F.unix_millis(F.col("ts").cast("timestamp")) % 7_200_000).alias("time_ms"), F.lit(0).cast("bigint").alias("pos"))
    fresh = e.where(F.col("event_type") == "click").drop("event_type").distinct()
    out = D.upsert_regions(e.where(F.col("event_type") != "click").drop("event_type"), fresh)
    return out.groupBy("media_id", "time_ms").agg(F.count(F.lit(1)).alias("n"))
