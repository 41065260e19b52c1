"""The registered queries of the operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import alignment, bitpack, chat_format, merkle, mixing, near_vectors, packing, pages, quality_rules, sharding, simhash, site_quality, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = [f"shard-{k:03d}" for k in range(128)]
SLOTS = 16_381


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _read(spark, folder, "labels")))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return site_quality.score_quality(_read(spark, folder, "documents"), _read(spark, folder, "labels"))


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_read(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _op4_sql() -> str:
    table = ", ".join(map(str, sharding.fill_table(SHARDS, SLOTS)))
    return f"""
        with slots as (
          select *, (('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint % {SLOTS})::integer as slot
          from documents)
        select doc_id, slot, ([{table}]::integer[])[slot + 1] as shard from slots"""


@query("op4_sharding", _op4_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARDS, SLOTS)


@query("op5_near_vectors")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.group_vectors(_read(spark, folder, "embeddings"))


@query("op6_main_text")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract(_read(spark, folder, "pages"))


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    manifest = bitpack.write_corpus(_read(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), keeps_spaces=True, end_id=2)
    return bitpack.read_documents(manifest)


@query("op8_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(
        _read(spark, folder, "documents"), _tokenizer("word_bpe_49k.json"), keeps_spaces=False, end_id=1, with_ids=False
    )
    return packed.drop("ids")


@query("op9_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    grouped = simhash.group_documents(_read(spark, folder, "documents"))
    return grouped.select("doc_id", simhash.hex_of(grouped["fp"]).alias("fingerprint"), "component_id")


PROBE = "<|im_end|><|im_start|>assistant ok"


def _op11_sql() -> str:
    a, z, sep = (len(chat_format.START), len(chat_format.END), len(chat_format.SEP))
    order = "order by turn nulls first, role, text"
    said = "filter (role = 'assistant')"
    return rf"""
        with turns as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'),
        marked as (
          select *, lag(role) over (partition by conv_id {order}) is distinct from role as opens,
                 length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as text_chars,
                 length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '{chat_format.FEED}')) as role_chars
          from turns)
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) as turns_sha256,
               coalesce(sum(length(text)) {said}, 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' {order}) {said}, '')) as loss_sha256,
               sum(text_chars + case when opens then {a + z + 2} + role_chars else {sep} end)::bigint as formatted_chars
        from marked group by conv_id"""


@query("op11_chat_format", _op11_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(probe)))


def _op12_sql() -> str:
    def leaf(n_chars: str) -> str:
        parts = ["doc_id", "source", "lang", n_chars, "text"]
        shown = [f"coalesce(strlen(cast({p} as varchar)) || ':' || cast({p} as varchar), '-')" for p in parts]
        return f"sha256({' || '.join(shown)})"

    # crc32 bit by bit: eight steps a byte
    crc = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(str_split(cast(doc_id as varchar), ''),
        lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295)"""
    up = """select grp, level + 1, idx // 2, sha256(string_agg(node, '' order by idx)), n
            from {t} where n > (1::bigint << level) group by grp, level, idx // 2, n"""
    return f"""
        with recursive leaves as (
          select doc_id, lang, {leaf("n_chars")} as leaf, case when {crc} % 7 = 0 then {leaf("(n_chars + 1)")} end as other
          from documents),
        placed as (
          select *, dense_rank() over (order by lang nulls first) - 1 as grp,
                 row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n
          from leaves),
        nodes(grp, level, idx, node, n) as (
          select grp, 0, idx, leaf, n from placed union all {up.format(t="nodes")}),
        subroots as (select grp, node as subroot from nodes where (1::bigint << level) >= n),
        tops(grp, level, idx, node, n) as (
          select 0, 0, grp, subroot, (select count(*) from subroots) from subroots union all {up.format(t="tops")}),
        roots as (select node as root from tops where (1::bigint << level) >= n),
        steps as (select 0 as tree, * from nodes union all select 1, * from tops),
        walk(doc, doc_id, leaf, subroot, grp, tree, level, idx, n, own, proof) as (
          select row_number() over (), doc_id, leaf, subroot, grp, 0, 0, idx, n, coalesce(other, leaf), ''
          from placed join subroots using (grp)
          union all
          select doc, doc_id, leaf, subroot, w.grp, case when done then 1 else w.tree end, case when done then 0 else w.level + 1 end,
                 case when done then w.grp else w.idx // 2 end, case when done then (select count(*) from subroots) else w.n end,
                 case when done then own when s.node is null then sha256(own) when s.idx < w.idx then sha256(s.node || own) else sha256(own || s.node) end,
                 proof || coalesce(s.node, '')
          from (select *, tree = 0 and (1::bigint << level) >= n as done from walk) w left join steps s
            on s.tree = w.tree and s.grp = (case when w.tree = 0 then w.grp else 0 end) and s.level = w.level and s.idx = xor(w.idx, 1)
          where not (w.tree = 1 and w.n <= (1::bigint << w.level)))
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, own as folded_root, own = root as verified
        from walk, roots where tree = 1 and (1::bigint << level) >= n"""


@query("op12_merkle_manifest", _op12_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.verified(merkle.manifest(docs, F.when(tampered, F.col("n_chars") + 1)))


@query("op13_cross_tokenizer")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokenizers(
        _read(spark, folder, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model")
    )
