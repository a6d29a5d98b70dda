"""The queries of the numbered operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in 40 shards of nearly equal bytes; null texts weigh 16 bytes, an empty table gives no rows."""
    from notemill.llm.sharding import shard_documents

    out = shard_documents(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of ``benchmark`` items in ``documents``, edited ones too: a row per document, item and span; none for null or empty texts."""
    from notemill.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of ``documents`` that stand in several places: the place that stays and those that can go."""
    from notemill.llm.substring_dedup import duplicate_spans

    return duplicate_spans(_table(spark, sf_dir, "documents")).drop("th")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text of ``documents``, learnt from three in four of them; ``und`` without a letter."""
    from notemill.llm.langid import held_out, identify, language_samples

    docs = _table(spark, sf_dir, "documents")
    samples = language_samples(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(docs.select("doc_id", "text"), samples).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from ``conversations``, formatted, and from one conversation that spells the template's marks."""
    from notemill.llm.chat import format_turns, read_back

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return read_back(format_turns(turns.unionByName(more)))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of the texts of ``documents`` under a model of six in seven of them; an empty text is its end token."""
    from notemill.llm.langid import held_out
    from notemill.llm.ngram_lm import score, train

    docs = _table(spark, sf_dir, "documents")
    out = held_out(folds=7)
    scored = score(docs, train(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each text of ``documents`` and the smallest id that it is linked with."""
    from notemill.llm.near_dup import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the tokenized ``documents`` and their places in sequences of at most 2,048 tokens."""
    from notemill.llm.packing import pack_documents

    out = pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the texts of ``documents`` state, with the sentences that tell."""
    from notemill.llm.licences import licence_scan

    return licence_scan(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For one ``embeddings`` row in a hundred its ten rows of highest inner product."""
    from notemill.llm.knn import top_k

    vectors = _table(spark, sf_dir, "embeddings")
    out = top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of ``documents``, some with a letter taken out by rule, and the more frequent words they are variants of."""
    from notemill.llm.spelling import count_words, letter_runs, spelling_forms

    # Shorter runs give no word of seven letters.
    runs = _table(spark, sf_dir, "documents").select("doc_id", F.explode(letter_runs("text", 7)).alias("run"))
    h, size = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return spelling_forms(count_words(runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("run")).alias("word"))))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in ``documents``, of which one in ten is made periodic from some word on."""
    from notemill.llm.periodic import periodic_runs

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, g = F.size("words").cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("words", place(i).cast("int")))
    # Texts without a change stay as they are: only the words count.
    changed = docs.withColumn("words", F.when(h % 10 == 0, words)).select("doc_id", F.when(F.size("words") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(changed)
    longest = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    nothing = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]))
    best = F.aggregate("runs", nothing, longest)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of four-word shingles have a similarity of 0.8 or more, linked to components."""
    from notemill.llm.bayes_dedup import near_duplicate_sets

    return near_duplicate_sets(_table(spark, sf_dir, "documents"), shingle=4)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from notemill.llm.licences import licence_sql

    return {"op9_licence_scan": licence_sql()}
