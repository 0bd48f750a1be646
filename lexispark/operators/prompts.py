"""References, prompts and re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispark.functions.text import strip


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def reference(source_type: Column, uri: Column, external_id: Column, title: Column) -> Column:
    """What a citation shows, by kind of source; empty strings count as missing."""
    uri, external_id, title = _filled(uri), _filled(external_id), _filled(title)
    git = F.coalesce(F.concat(uri, F.lit(" -> "), external_id), uri, external_id, title)
    return F.when(source_type == "web", F.coalesce(external_id, uri, title)).when(source_type == "git", git).when(source_type == "file", F.coalesce(title, external_id, uri)).otherwise(F.coalesce(uri, external_id, title))


def passage_input(text: Column) -> Column:
    return F.concat(F.lit("passage: "), text)


def query_input(text: Column) -> Column:
    return F.concat(F.lit("query: "), text)


def history_block(messages: DataFrame) -> DataFrame:
    """conv_id, history: ``messages(conv_id, position, role, text)`` as ``ROLE: text`` lines in order."""
    line = F.concat(F.upper("role"), F.lit(": "), "text")
    ordered = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("history"))


def context_block(chunks: DataFrame) -> DataFrame:
    """query_id, context: ``chunks(query_id, rank, citation, text)`` as numbered blocks with rules between. The budget
    of limit_context bounds what is gathered."""
    block = F.concat(F.lit("["), "citation", F.lit("]\n"), "text")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return chunks.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def rerank(candidates: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best by ``rerank_score`` of each query of ``candidates(query_id, rank, rerank_score)``; missing
    scores last, ties by the earlier rank. The score comes from an adapter's column."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return candidates.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= limit)


def attempted(hits: DataFrame, attempts: int = 3) -> DataFrame:
    """Of ``hits(query_id, rank, blocked, indexed)``, those that are tried: in order, blocked ones aside, until one is
    indexed or ``attempts`` have been made."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    free = hits.filter(~F.col("blocked"))
    done = F.coalesce(F.sum(F.col("indexed").cast("int")).over(order), F.lit(0))
    tried = F.count("*").over(order)
    return free.withColumn("_done", done).withColumn("_tried", tried).filter((F.col("_done") == 0) & (F.col("_tried") < attempts)).drop("_done", "_tried")


def reindex(chunks: DataFrame) -> DataFrame:
    """chunk_index 0..n-1 over the chunks that are left of each document, and how many they are."""
    w = Window.partitionBy("document_id")
    return chunks.withColumn("chunk_index", F.row_number().over(w.orderBy("chunk_index")) - 1).withColumn("document_chunk_count", F.count("*").over(w))


# Fixed texts of the prompt.
NO_CONTEXT = "INDEXED CONTEXT:\nNo relevant indexed context was found."
INSTRUCTION = "Answer the question now. Use source citations such as [S1] when the answer relies on the indexed context."


def prompt(questions: DataFrame, context: DataFrame, history: DataFrame | None = None, most: int = 8) -> DataFrame:
    """query_id, prompt for every row of ``questions(query_id, question)``.

    ``context(query_id, rank, citation, source_name, title, reference, text)`` is what limit_context kept,
    ``history(query_id, position, role, text)`` earlier messages: the last ``most`` count, of which those of other roles
    and blank ones are left out.
    """
    header = F.concat(F.lit("["), "citation", F.lit("]\nSource: "), "source_name", F.lit("\nDocument: "), "title", F.coalesce(F.concat(F.lit("\nReference: "), _filled(F.col("reference"))), F.lit("")))
    block = F.concat(header, F.lit("\nContent:\n"), strip(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    found = context.groupBy("query_id").agg(F.concat(F.lit("INDEXED CONTEXT:\n\n"), F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n---\n\n")).alias("_context"))
    asked = questions.join(found, "query_id", "left")
    if history is not None:
        newest = Window.partitionBy("query_id").orderBy(F.desc("position"))
        said = history.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= most)
        role = F.lower(F.trim("role"))
        said = said.filter(role.isin("user", "assistant") & (strip(F.col("text")) != ""))
        line = F.concat(F.upper(role), F.lit(": "), strip(F.col("text")))
        lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
        blocks = said.groupBy("query_id").agg(F.concat(F.lit("CHAT HISTORY:\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("_history"))
        asked = asked.join(blocks, "query_id", "left")
    parts = [F.col("_history")] if history is not None else []
    parts += [F.coalesce("_context", F.lit(NO_CONTEXT)), F.concat(F.lit("USER QUESTION:\n"), strip(F.col("question"))), F.lit(INSTRUCTION)]
    return asked.select("query_id", F.concat_ws("\n\n", *parts).alias("prompt"))


def traced(chunks: DataFrame) -> DataFrame:
    """query_id, rank, trace: what is recorded of each chunk used."""
    return chunks.select("query_id", "rank", F.struct("citation", "source_id", "source_name", "document_id", "title", "chunk_id", "chunk_index", "score", "rerank_score").alias("trace"))
