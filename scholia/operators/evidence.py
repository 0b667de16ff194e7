"""From retrieved records to an answer's sources, prompt and confidence."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.calls import client, timed

DIRECT, PARTIAL = 0.025, 0.015
# Texts that go with an answer.
NO_ANSWER = "I do not have sufficient evidence in the ingested documents to answer this question. Please ingest relevant documents or refine your query."
PROMPT = """You are a research assistant answering questions based strictly on provided source documents.

QUESTION: %s

RETRIEVED EVIDENCE:
%s

INSTRUCTIONS:
- Answer based ONLY on the evidence above.
- Start with the direct answer.
- Cite sources using [1], [2], etc. matching the evidence block numbers.
- If evidence is weak or partial, say so clearly.
- Do not invent facts not supported by the evidence.
- Do not cite page numbers not present in the evidence.
- Keep the answer focused and clear.

ANSWER:"""


def support_level(score: Column) -> Column:
    return F.when(score > DIRECT, "direct").when(score > PARTIAL, "partial").otherwise("weak")


def snippet(text: Column, most: int) -> Column:
    return F.concat(F.left(text, F.lit(most)), F.when(F.length(text) > most, "…").otherwise(""))


def sources(hits: DataFrame) -> DataFrame:
    """A row a retrieved record: query_id, rank, pos, source, pages, snippet, support."""
    return hits.select("query_id", "rank", "pos", "source", "page_start", "page_end", "section_path", snippet(F.col("text"), 300).alias("snippet"), support_level(F.col("score")).alias("support_level"), "score")


def prompts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, prompt: the first five records as numbered evidence in a fixed frame."""
    pages = F.when(F.col("page_start") == F.col("page_end"), F.format_string("p. %d", "page_start")).otherwise(F.format_string("pp. %d–%d", "page_start", "page_end"))
    block = F.concat(F.format_string("[%d] Source: %s (", F.col("rank") + 1, F.col("source")), pages, F.coalesce(F.concat(F.lit(" § "), F.col("section_path")), F.lit("")), F.lit(")\n"), F.left("text", F.lit(1000)))
    listed = hits.where("rank < 5").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n---\n\n").alias("evidence"))
    return questions.join(listed, "query_id").select("query_id", F.format_string(PROMPT, "query", "evidence").alias("prompt"))


def extractive(prompt: str) -> str:
    """A stand-in for a language model: the first evidence's first sentence, cited."""
    body = prompt.split("RETRIEVED EVIDENCE:\n", 1)[-1].split("\n", 1)[-1]
    return body.split(". ")[0].strip()[:300] + " [1]"


EMPTY = "the model gave no text"
#: Seconds that a call may take, and calls at a time.
SECONDS, AT_ONCE = 180.0, 4


def answer(
    prompts_of: DataFrame, generate: Callable[[str], str] = extractive, connect: Callable[[], Callable[[str], str]] | None = None, seconds: float = SECONDS, at_once: int = AT_ONCE
) -> DataFrame:
    """query_id, answer (null where generating failed), error. generate is called in tasks,
    `at_once` calls at a time; one that takes longer than `seconds`, or gives no text,
    has failed. connect: makes the function, once a worker."""
    own = uuid.uuid4().hex

    def run(frames):
        model = client(own, connect) if connect else generate
        for f in frames:
            found = [(None, EMPTY) if error is None and not (text or "").strip() else (text, error) for text, error in timed(model, f.prompt.tolist(), seconds, at_once)]
            yield f[["query_id"]].assign(answer=[t for t, _ in found], error=[e for _, e in found])

    return prompts_of.mapInPandas(run, f"query_id {dict(prompts_of.dtypes)['query_id']}, answer string, error string")


# Reasons and warnings.
NO_CHUNKS, NO_EVIDENCE, CALL_FAILED = "No relevant chunks were retrieved.", "No evidence found in the document corpus for this query.", "LLM call failed."
UNPAGED, UNSURE = "Some sources missing page numbers.", "Evidence quality is low. Answer may not be fully grounded."
SAID_SO, PARTLY, WEAKLY = "LLM indicated insufficient evidence.", "Partial evidence found; some claims may need verification.", "Weak evidence; answer may not be fully supported."


def confidence(hits: DataFrame, questions: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """query_id, confidence, reason, warnings (an array), n_direct, for every question. What
    counts are its first five hits."""
    stats = hits.where("rank < 5").groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") > DIRECT).alias("n_direct"), F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("best"), F.count_if(F.col("page_start") > 0).alias("paged")
    )
    rows = questions.select("query_id").join(stats, "query_id", "left")
    if answers is None:
        rows = rows.withColumns({"_said": F.lit(""), "_error": F.lit(None).cast("string")})
    else:
        rows = rows.join(answers.select("query_id", F.lower("answer").alias("_said"), F.col("error").alias("_error")), "query_id", "left")
    said = F.coalesce(F.contains(F.col("_said"), F.lit("i do not")) | F.contains(F.col("_said"), F.lit("not found")), F.lit(False))
    n, direct = F.coalesce("n", F.lit(0)), F.coalesce("n_direct", F.lit(0))
    none, failed = n == 0, F.col("_error").isNotNull()
    high, medium = (direct >= 2) & (F.col("best") > DIRECT), (direct >= 1) | (F.col("best") > PARTIAL)
    pick = lambda *values: F.when(none, values[0]).when(failed, values[1]).when(said, values[2]).when(high, values[3]).when(medium, values[4]).otherwise(values[5])
    reason = pick(NO_CHUNKS, CALL_FAILED, SAID_SO, F.concat(direct.cast("string"), F.lit(" directly relevant chunks found.")), PARTLY, WEAKLY)
    warned = F.array_compact(F.array(F.when(F.col("paged") < n, UNPAGED), F.when(~said & ~high & ~F.coalesce(medium, F.lit(False)), UNSURE)))
    warnings = F.when(none, F.array(F.lit(NO_EVIDENCE))).when(failed, F.array(F.concat(F.lit("Generation error: "), "_error"))).otherwise(warned)
    return rows.select("query_id", pick("insufficient", "insufficient", "low", "high", "medium", "low").alias("confidence"), reason.alias("reason"), warnings.alias("warnings"), direct.cast("long").alias("n_direct"))


def respond(hits: DataFrame, questions: DataFrame, generate: Callable[[str], str] = extractive) -> DataFrame:
    """query_id, answer, confidence, reason, warnings, for every question: without a hit
    that there is no evidence, and where generating failed why."""
    said = answer(prompts(hits, questions), generate)
    said = said.persist()
    judged = confidence(hits, questions, said).drop("n_direct").join(said, "query_id", "left")
    text = F.when(F.col("error").isNotNull(), F.concat(F.lit("Answer generation failed: "), "error")).otherwise(F.coalesce("answer", F.lit(NO_ANSWER)))
    return judged.select("query_id", text.alias("answer"), "confidence", "reason", "warnings")


def evidence_quality(level: Column) -> Column:
    return F.when(level == "high", "strong").when(level == "medium", "partial").otherwise("weak")
