"""Registered queries of the training-data operators: given tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deckloom.llm import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = dict(checks.SQL)


def query(name: str):
    def wrap(fn):
        QUERIES[name] = fn
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slides(documents: DataFrame, *more: str) -> DataFrame:
    """The documents as slide texts."""
    return documents.select(F.col("doc_id").alias("slide_id"), "text", *more)


@query("op9_mixing")
def op9_mixing(spark, sf_dir):
    from deckloom.llm.mixing import mix_sources

    mixed = mix_sources(slides(table(spark, sf_dir, "documents"), "source"))
    return mixed.select(F.col("slide_id").alias("doc_id"), "size", "source_size", F.round("target", 3).alias("target"), "taken")


@query("op7_language")
def op7_language(spark, sf_dir):
    from deckloom.llm.language import detect_language, fit_languages, training_part

    texts = slides(table(spark, sf_dir, "documents"), "lang")
    found = detect_language(texts.select("slide_id", "text"), fit_languages(texts))
    return found.select(
        F.col("slide_id").alias("doc_id"), (training_part(F.col("slide_id")) == 0).alias("held_out"),
        "language.lang_pred", "language.score", "language.cross_entropy", "language.rejected")


@query("op4_bpe")
def op4_bpe(spark, sf_dir):
    import public_tokenizers

    from deckloom.llm.bpe import encode_slides

    done = encode_slides(slides(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN)
    return done.select(F.col("slide_id").alias("doc_id"), "tokens.*")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    import public_tokenizers

    from deckloom.llm.token_files import read_token_files, write_token_files
    from deckloom.session import shared_dir

    path = shared_dir(spark, "token-files")
    write_token_files(slides(table(spark, sf_dir, "documents")), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).withColumnRenamed("slide_id", "doc_id")


def trusted(labels: DataFrame) -> DataFrame:
    """Slides labelled as good and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("slide_id"))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    from deckloom.llm.quality import fit_ratios, quality_rules

    texts = slides(table(spark, sf_dir, "documents"))
    judged = quality_rules(texts, fit_ratios(texts, trusted(table(spark, sf_dir, "labels"))))
    return judged.select(F.col("slide_id").alias("doc_id"), "quality.*")


@query("op1_simhash")
def op1_simhash(spark, sf_dir):
    from deckloom.llm.simhash import near_duplicates

    return near_duplicates(slides(table(spark, sf_dir, "documents"))).withColumnRenamed("slide_id", "doc_id")


#: The rules of the crawl (fixed values of the contract).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op8_links")
def op8_links(spark, sf_dir):
    from deckloom.llm.links import judge_targets

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("rel_id"), F.col("url").alias("target"))
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("number"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    # A page shows the document whose number ends its path.
    numbered = pages.withColumn("number", F.regexp_extract("target", "://[^/?#]*[^?#]*/([0-9]+)", 1))
    judged = judge_targets(pages, numbered.where("number <> ''").join(labels, "number").select("target", "bad"), RULES)
    return judged.select(F.col("rel_id").alias("page_id"), "host", "path", "rule", "verdict", "template")


@query("op6_licences")
def op6_licences(spark, sf_dir):
    from deckloom.llm.licences import license_scan

    return license_scan(slides(table(spark, sf_dir, "documents"))).withColumnRenamed("slide_id", "doc_id")


@query("op2_topk")
def op2_topk(spark, sf_dir):
    from deckloom.llm.topk import top_matches

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slide_id"), F.col("embedding").alias("features"))
    return top_matches(vectors, vectors.where("slide_id % 50 = 0"), 5).withColumnRenamed("slide_id", "vec_id")


@query("op5_article")
def op5_article(spark, sf_dir):
    from deckloom.llm.article import extract_articles

    done = extract_articles(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))


@query("op13_filter_audit")
def op13_filter_audit(spark, sf_dir):
    from deckloom.llm.filter_audit import audit_filters

    reviews = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("slide_id"), (F.col("quality") == 1).alias("content_preserved"), (F.col("toxic") != 1).alias("layout_valid"))
    return audit_filters(slides(table(spark, sf_dir, "documents"), "source"), reviews)


@query("op11_run_repair")
def op11_run_repair(spark, sf_dir):
    from deckloom.llm.run_repair import repair_messages, repair_report

    given = table(spark, sf_dir, "conversations")
    number, turn = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn"))
    harm = F.crc32(F.concat(number, F.lit(":"), turn)) % 20
    role, text = (F.coalesce(F.col(n), F.lit(" ")) for n in ("role", "text"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    damaged = given.withColumn("harm", harm).where("harm <> 0").select(
        F.col("conv_id").alias("trace_id"), "turn", F.when(F.col("harm") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        copies.alias("copy"))
    edits = repair_messages(damaged, given.select(F.col("conv_id").alias("trace_id")))
    return repair_report(edits).withColumnRenamed("trace_id", "conv_id")


def _payload(turns):
    """A conversation's request payload: short ones in flat layouts, others as messages with texts or with parts."""
    roles = F.array_join(F.transform(turns, lambda t: t["role"]), ",")

    def body(**fields):
        return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))

    flat = F.when((F.size(turns) == 2) & (roles == "user,assistant"), body(prompt=F.get(turns, 0)["text"], completion=F.get(turns, 1)["text"]))
    flat = flat.when((F.size(turns) == 3) & (roles == "system,user,assistant"), body(
        instructions=F.get(turns, 0)["text"], input=F.get(turns, 1)["text"], output=F.get(turns, 2)["text"]))
    parts = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(
        F.lit("input_text").alias("type"), t["text"].alias("text"))).alias("content")))
    plain = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return flat.when(F.size(turns) % 2 == 0, body(model=F.lit("m"), input=parts)).otherwise(body(messages=plain))


@query("op12_chat_format")
def op12_chat_format(spark, sf_dir):
    from deckloom.llm.chat_format import format_chats, learned_text, read_turns

    role, text = (F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("role", "text"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role, text))).alias("turns"))
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
        for i, r in enumerate(("user", "assistant"))]).alias("turns"))
    requests = turns.unionByName(probe).select(F.col("conv_id").alias("trace_id"), _payload(F.col("turns")).alias("payload_json"))
    done = format_chats(requests).select("trace_id", "chat.*")
    back = done.select(F.col("trace_id").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"),
                       learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                       F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"))
