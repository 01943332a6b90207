"""The numbered operators as registered queries: production parameters, whole tables, digests of their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import alignment, bpe, chat, codes, exact, html, langid, lm, mixing, simhash, sketches, spans, vectors
from emberwatch.session import load_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
IN_FIVE = "crc32(cast(doc_id as string)) % 5"
DOMAIN = "concat('d', cast(substring(source, 4) as int) % 4)"
MIX = mixing.Mix(weights={"domain": {"d0": 2, "d1": 3}, "lang": {"en": 4, "de": 2}}, budget_share=0.75, max_epochs=3,
                 seed=42)

TOOLS: chat.Schemas = {
    "search": {"query": chat.Parameter("string", True), "limit": chat.Parameter("integer", True, least=1, most=100)},
    "lookup": {"term": chat.Parameter("string", True), "exact": chat.Parameter("boolean"),
               "text": chat.Parameter("string")},
    "summarise": {"text": chat.Parameter("string", True), "style": chat.Parameter("string", True, ("short", "long"))},
}


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(load_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    model = langid.train_filter(docs.filter(f"coalesce({IN_FIVE}, 0) <> 0"))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(F.expr(f"{IN_FIVE} = 0"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprinted(load_table(spark, sf_dir, "documents"))


def op4_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(load_table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return mixing.mixed(docs, F.expr(DOMAIN), MIX)


def _op5_sql() -> str:
    """The same budgets and prefixes, level by level, with plain windows."""
    weight = {k: "case " + " ".join(f"when {k} = '{v}' then {w}::double" for v, w in MIX.weights.get(k, {"": 1}).items())
              + " else 1::double end" for k in mixing.LEVELS}
    epochs = f"{float(MIX.max_epochs)}::double"
    sql = rf"""
    with docs as (select doc_id, coalesce('d' || (cast(substr(source, 4) as int) % 4), '(none)') as domain,
        coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as n_tokens from documents),
    leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from docs group by all having tokens > 0),
    b0 as (select least(sum(tokens) * {epochs}, sum(tokens) * {MIX.budget_share}::double) as budget from leaves)"""
    for i, key in enumerate(mixing.LEVELS):
        parents = list(mixing.LEVELS[:i])
        cols = ", ".join([*parents, key])
        part = f"partition by {', '.join(parents)}" if parents else ""
        join = f"join b{i} using ({', '.join(parents)})" if parents else "cross join b0"
        sql += f""",
    c{i} as (select {cols}, cap, budget as parent_budget, {weight[key]} as w from
        (select {cols}, sum(tokens * {epochs}) as cap from leaves group by {cols}) {join}),
    l{i} as (select *, (parent_budget - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
        / sum(w) over (o rows between current row and unbounded following) as level
        from c{i} window o as ({part} order by cap / w, {key})),
    b{i + 1} as (select {cols}, least(cap, w * max(level) over ({part})) as budget from l{i})"""
    return sql + f""",
    targets as (select *, floor(budget + 0.5)::bigint as target from b3 join leaves using (domain, lang, source)),
    cuts as (select domain, lang, source, target, target // tokens as epochs, target % tokens as rest from targets),
    placed as (select *, md5('{MIX.seed}:' || epochs || ':' || coalesce(doc_id::varchar, '')) as key
        from docs left join cuts using (domain, lang, source)),
    running as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by key
        range between unbounded preceding and current row), 0) - sum(n_tokens) over
        (partition by domain, lang, source, key) as before from placed)
    select doc_id, domain, lang, source, n_tokens, coalesce(target, 0) as target,
        coalesce(epochs + (before < rest)::int, 0)::int as copies from running"""


def op6_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 10 = 0"), F.lit(False))
    model, counts = lm.train(docs.filter(~held_out))
    return lm.score(docs, model, counts).withColumn("held_out", held_out)


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(load_table(spark, sf_dir, "documents"), BYTE_BPE)


def tool_traffic(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each assistant turn read as a call with its whole text, each user turn as the result of the turn before it.

    All other turns are results of no call. A call needs the one two turns before; the calls numbered 1, 3, 7, 15 and so
    on (turn div 2) also need those four and six turns before, and in one conversation of 50 the first of these needs
    the call after it too, which closes a cycle. Turns without such neighbours give unanswered calls, orphans and needs
    that name no call; long texts and missing styles fail their schemas.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.split(text, " ")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    search = F.to_json(F.struct(text.alias("query"), F.size(words).alias("limit")))
    term = F.get(words, F.lit(0))
    lookup = F.to_json(F.struct(term.alias("term"), (F.length(term) % 2 == 0).alias("exact"), F.col("text")))
    style = F.when(F.size(words) < 40, "short").when(F.size(words) > 80, "long")
    summarise = F.to_json(F.struct(style.alias("style"), F.col("text").alias("text")))
    call = lambda step: F.concat(F.lit("call_"), F.col("turn") + step)
    number = F.expr("turn div 2")
    needs = F.concat(
        F.array(call(-2)),
        F.when((number > 0) & (number.bitwiseAND(number + 1) == 0), F.array(call(-4), call(-6))).otherwise(F.array()),
        F.when((number == 1) & (F.pmod("conv_id", F.lit(50)) == 7), F.array(call(2))).otherwise(F.array()))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", call(0).alias("call_id"),
        F.when(kind == 0, "search").when(kind == 1, "lookup").otherwise("summarise").alias("name"),
        F.when(kind == 0, search).when(kind == 1, lookup).otherwise(summarise).alias("arguments"), needs.alias("needs"))
    results = turns.filter("role is null or role <> 'assistant'").select(
        "conv_id", "turn", F.when(F.col("role") == "user", call(-1)).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_traffic(load_table(spark, sf_dir, "conversations"))
    return chat.exchanges(calls, results, TOOLS)


def op9_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.section_tokens(load_table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(load_table(spark, sf_dir, "documents")).drop("fp")


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(load_table(spark, sf_dir, "embeddings")).drop("label")


def _op11_sql() -> str:
    """The same rounds over one row per component; a distance and its entry are one number, so that ties go low."""
    sql = f"""
    with numbered as (select *, row_number() over (order by vec_id) as r from embeddings where embedding is not null),
    scalars as (select r, len(embedding) as n, unnest(embedding)::double as v, unnest(range(len(embedding))) as i from numbered),
    kept as (select row_number() over (order by vec_id) as k, * from numbered
        where r not in (select r from scalars where v is null or not isfinite(v))),
    x as (select k, i // (n // {codes.PARTS}) as p, i % (n // {codes.PARTS}) as c, floor({codes.SCALE} * v)::bigint as x
        from scalars join kept using (r)),
    b0 as (select p, k - 1 as e, c, x from x where k <= {codes.ENTRIES})"""
    for i in range(codes.ROUNDS + 1):
        sql += f""",
    d{i} as (select k, p, e, sum((x.x - b.x) * (x.x - b.x))::bigint as d from x join b{i} b using (p, c) group by all),
    a{i} as (select k, p, min(d * {codes.ENTRIES} + e) as best from d{i} group by all)"""
        if i < codes.ROUNDS:
            sql += f""",
    m{i} as (select p, best % {codes.ENTRIES} as e, c, sum(x)::bigint as s, count(*) as n from a{i} join x using (k, p) group by all),
    b{i + 1} as (select p, e, c, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.x) as x
        from b{i} b left join m{i} m using (p, e, c))"""
    last = codes.ROUNDS
    return sql + f""",
    coded as (select k, string_agg(format('{{:02x}}', best % {codes.ENTRIES}), '' order by p) as code,
        sum(best // {codes.ENTRIES})::bigint as error from a{last} group by k)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
        (select sha256(string_agg(x::varchar, ',' order by p, e, c)) from b{last}) as codebooks_sha256
    from coded join kept using (k)"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(load_table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicated(load_table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
    with texts as (select doc_id, regexp_replace(coalesce(text, ''), '{exact.BLANKS}', ' ', 'g') as norm from documents)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
        row_number() over w = 1 as kept, sha256(norm) as text_sha256
    from texts window w as (partition by norm order by doc_id)"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_html_extraction": (op1_html_extraction, None),
    "op2_language_id": (op2_language_id, None),
    "op3_scaled_sketch": (op3_scaled_sketch, None),
    "op4_metric_range_join": (op4_metric_range_join, None),
    "op5_source_mixing": (op5_source_mixing, _op5_sql()),
    "op6_gated_lm": (op6_gated_lm, None),
    "op7_bpe_transducer": (op7_bpe_transducer, None),
    "op8_tool_calls": (op8_tool_calls, None),
    "op9_token_spans": (op9_token_spans, None),
    "op10_simhash_near_dedup": (op10_simhash_near_dedup, None),
    "op11_code_compression": (op11_code_compression, _op11_sql()),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_exact_dedup": (op13_exact_dedup, OP13_SQL),
}
