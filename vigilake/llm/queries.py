"""The registered queries of this subpackage, one thin opN_<name> for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm import oracle
from vigilake.session import shared_dir, ship, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.bpe import digest_documents

    ship(spark)
    return digest_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.quality import judge

    docs = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", *(f"verdict.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.packing import pack_digests

    ship(spark)
    return pack_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.warc import read_archives, write

    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write(table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).drop("target_uri")


#: Fixed rules of the query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.token_counts import token_counts

    ship(spark)
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.chat import digest_conversations

    hard = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(hard).alias("text"))
    return digest_conversations(turns.union(own))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.language import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "language.*")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.search import top_documents

    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: of documents whose h = crc32(doc_id as text) is divisible by 10, words from a on repeat with period p.

    g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) for a text of n words.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).alias("g"))
    cut = cut.withColumn("words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    cut = cut.withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.expr("cast((n - a + p - 1) div p as int)")))
    planted = F.array_join(F.concat(F.slice("words", 1, F.col("a")), F.slice(again, 1, F.col("n") - F.col("a"))), " ")
    return cut.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.runs import periodic_runs

    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    span = (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")
    return best.select("doc_id", "n_runs", *span, F.expr("-(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilake.llm.repeats import repeated_strings

    found = repeated_strings(table(spark, sf_dir, "documents"), 400)
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_bpe": op1_bpe, "op2_quality": op2_quality, "op3_packing": op3_packing, "op4_vectors": op4_vectors, "op5_warc": op5_warc, "op6_urls": op6_urls, "op7_token_counts": op7_token_counts, "op8_chat": op8_chat, "op9_language": op9_language, "op10_minhash": op10_minhash, "op11_tput": op11_tput, "op12_runs": op12_runs, "op13_repeats": op13_repeats}
#: Learned, sketched and tokenizing operators can't be expressed; they are tested against libraries and brute force.
ORACLE_SQL: dict[str, str] = {"op4_vectors": oracle.OP4, "op5_warc": oracle.OP5, "op6_urls": oracle.op6(URL_RULES), "op8_chat": oracle.OP8, "op11_tput": oracle.OP11, "op13_repeats": oracle.OP13}
