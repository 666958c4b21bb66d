"""The query of each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yieldloom.llm.common import new_path, table

#: Folder of the public tokenizers' files; "" stands for that of the installed package.
TOKENIZERS = ""


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import warc

    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.digest(spark, path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import lines

    return lines.deduplicate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from yieldloom.llm import nearest

    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import secrets

    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "ledger")
    secrets.update(docs, path, secrets.BASE)
    paths = secrets.update(docs, path, secrets.RULES)  # every blob lacks the added rules alone
    return secrets.digest(secrets.findings(paths, secrets.read_ledger(spark, path)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import language

    return language.identify(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import token_files

    path = new_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_files.digest(spark, path)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, limit=2048)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import infill

    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import conversations

    rows = table(spark, sf_dir, "conversations")
    return conversations.digest(conversations.damage(rows), rows)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from yieldloom.llm import exact

    return exact.groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from yieldloom.llm import exact, infill, lines

    return {"op4_line_dedup": lines.ORACLE_SQL, "op11_infill": infill.ORACLE_SQL, "op13_exact_dedup": exact.ORACLE_SQL}
