"""The registered queries of this subpackage: thin adapters from the operators to the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, descent, fim, grams, langid, mixing, neighbours, packing, quality, simhash, substring, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 16 words, so that a source of a few dozen words meets its target too."""
    return mixing.mix(table(spark, sf_dir, "documents"), block_tokens=16).select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items by document: doc_id, item_id, share, identical."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _judged(scored: DataFrame, modulus: int, remainder: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", grams.held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels.where(~grams.held_out(4, 2)))
    return _judged(quality.score(documents, model), 4, 2, 0.7)


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(~grams.held_out(3, 1)))
    return _judged(toxicity.score(documents, model), 3, 1, 0.7)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~grams.held_out(3, 1)))
    found = langid.identify(documents, model)
    return found.select("doc_id", grams.held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    kinds = dict(rows.dtypes)
    extra = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(rows.unionByName(extra))
    back = chats.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escaped",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    text = fim.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_quality, op4_simhash_components, op5_pack_tokens, op6_toxicity, op7_language_id, op8_substring_dedup, op9_nearest, op10_chat_format, op11_fill_in_middle, op12_whitening, op13_embedding_dedup)}
#: SQL where it can express the result.  XXH64, learned scores, byte-pair tokens and an approximate index have none; tests/llm
#: holds those queries against brute-force versions instead.
ORACLE: dict[str, str] = {
    "op8_substring_dedup": r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
        x as (select doc_id, s, array_to_string(w[s:s + 49], ' ') k from d, lateral (select unnest(range(1, len(w) - 48)) s)),
        m as (select k, min(doc_id) f from x group by k),
        r as (select distinct doc_id, unnest(range(s, s + 50)) i from x join m using (k) where f < doc_id),
        g as (select doc_id, list(i) gone from r group by 1)
        select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
            sha256(array_to_string(case when gone is null then w else list_filter(w, lambda e, i: not list_contains(gone, i)) end, ' ')) as kept_sha256 from d left join g on d.doc_id = g.doc_id""",
    "op10_chat_format": r"""with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations union all select -7, t, case t when 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) r(t)),
        e as (select *, bool_or(contains(text, '</turn>' || chr(10)) or regexp_matches(text, '\\[\\#/ ]') or regexp_matches(role, '\\[\\#/ ]') or contains(role, ': ')) over (partition by conv_id) as escaped from c)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars, sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
            cast(sum(14 + length(role) + length(text) + case when escaped then len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '#')) - len(regexp_extract_all(text, '#+')) + len(regexp_extract_all(text, '</turn>')) else 0 end) as bigint) as formatted_chars, escaped from e group by conv_id, escaped""",
    "op11_fill_in_middle": r"""with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) h from documents),
        e as (select *, len(u) n, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2, ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4 from d),
        f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form from e),
        g as (select *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from f)
        select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from g""",
}
