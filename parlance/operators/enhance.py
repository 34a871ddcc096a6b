"""Entry point A as one plan: segments -> token counts -> packing -> chunk
payloads -> model -> cleaning -> audit -> recombination -> entities -> lineage
-> store validation.

Shuffles: the packing fold (on the transcript), the chunk payload aggregation
(transcript, chunk), the recombination and audit aggregations (transcript) and
the entity fold (transcript); the model runs in ``mapInPandas`` over the chunk
rows, so chunks are the unit of parallelism rather than transcripts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.answers import AnswerStore, apply_model_by_language, ask_once
from parlance.operators.entities import DEFAULT_CATALOGUE, entity_map, extract_entities
from parlance.operators.models import ModelFactory, answers_audit, apply_model, clean_model_output, echo_model_factory, entities_with_model
from parlance.operators.packing import DEFAULT_BUDGET, pack_chunks, token_counts
from parlance.operators.recombine import chunk_payload, combine_chunks
from parlance.schemas import JOB_PREFIX
from parlance.session import ensure_checkpoint_dir
from parlance.sinks.results import store_validation


def enhance(
    segments: DataFrame,
    *,
    transcripts: DataFrame | None = None,
    model_factory: ModelFactory = echo_model_factory,
    entity_model: ModelFactory | None = None,
    answers: DataFrame | None = None,
    budget: int = DEFAULT_BUDGET,
    catalogue=DEFAULT_CATALOGUE,
    bucket: str = "results",
    key: str = "transcript_id",
    exact_json: bool = False,
    model_concurrency: int | None = None,
    languages: DataFrame | None = None,
    answer_store: AnswerStore | None = None,
) -> DataFrame:
    """``segments``: key, seg_no (dense ordinal), timestamp, speaker, text and, if known, reject_reason.

    ``transcripts`` lists every transcript with the place its result belongs to: key,
    ``bucket`` and ``job_key`` (the object ``<job>.json``).  Without it the transcripts are
    those with segments, in the default ``bucket``, under the job named after the key.

    ``entity_model`` extracts entities instead of the rule ``catalogue``; a transcript for
    which it fails is stored without entities, with status NER_FAILED.

    ``answers`` (key, chunk_no, response) are model answers of an earlier run: chunks that
    have one are not asked again.  ``answer_store`` keeps answers by request instead, as they come: a lost executor or a run
    that broke off costs no answered request (``operators.answers``).

    ``languages`` (key, language) routes chunks: ``model_factory`` is then called with the language, once for each
    client, and a client sees one language (a transcript without one: the default language).

    Output, one row per transcript: ``transcript, segments, entities, s3`` (D10) plus
    ``status`` (OK / PARTIAL / FAILED / NER_FAILED), ``n_chunks``, ``n_lost``, ``n_rejected``
    (segments with a reject reason), ``reject_reason`` and ``output_key``.  A transcript
    without segments, or whose chunks all failed, has status FAILED and a reject reason.
    """
    # the segment table is written once: an upstream interval join must not run twice
    ensure_checkpoint_dir(segments.sparkSession)
    counted = token_counts(segments).checkpoint(eager=True)
    rejected = counted.where(F.col("reject_reason").isNotNull()) if "reject_reason" in counted.columns else None
    packed = pack_chunks(counted.drop("reject_reason"), budget, key=key)
    requests = chunk_payload(packed, key=key).select(key, "chunk_no", "payload")
    known = None if answers is None else answers.where(F.col("response").isNotNull()).select(key, "chunk_no", "response").dropDuplicates([key, "chunk_no"])
    if known is not None:
        requests = requests.join(known.select(key, "chunk_no"), [key, "chunk_no"], "left_anti")
    if languages is not None:
        requests = requests.join(languages.select(key, "language"), key, "left")
    if answer_store is not None:
        answered = ask_once(requests, model_factory, answer_store, language="language" if languages is not None else None, concurrency=model_concurrency)
    elif languages is not None:
        answered = apply_model_by_language(requests, model_factory)
    else:
        answered = apply_model(requests, model_factory, concurrency=model_concurrency, spread_by=[key, "chunk_no"])
    answered = answered.select(key, "chunk_no", "response", "response_error")
    if known is not None:
        chunks = packed.select(key, "chunk_no").distinct()
        answered = answered.unionByName(known.join(chunks, [key, "chunk_no"], "left_semi").withColumn("response_error", F.lit(None).cast("string")))
    # answers and what was read from them are written once: the model is called once per
    # chunk, each answer is parsed once, and a retried task cannot silently ask again
    cleaned = clean_model_output(answered, exact_json=exact_json).select(key, "chunk_no", "ok", "error", "transcript", "segments").checkpoint(eager=True)
    # one row per chunk sent, so the audit is one aggregation
    audit = answers_audit(cleaned, key=key)
    combined = combine_chunks(cleaned.select(key, "chunk_no", "transcript", "segments", "ok"), key=key, ok="ok")
    combined = combined.checkpoint(eager=True)  # read by the entities and by the document
    status = F.col("status")
    if entity_model is None:
        long = extract_entities(combined.select(key, F.col("transcript").alias("text")), catalogue, key=key)
    else:
        long, failures = entities_with_model(combined, entity_model, key=key)
        failed = failures.select(key, F.lit(True).alias("_ner_failed"))
    ents = entity_map(long, key=key)
    if transcripts is None:
        job = F.col(key).cast("string")
        job = F.when(F.startswith(job, F.lit(JOB_PREFIX)), job).otherwise(F.concat(F.lit(JOB_PREFIX), job))
        transcripts = counted.select(key).distinct().select(key, F.lit(bucket).alias("bucket"), F.concat(job, F.lit(".json")).alias("job_key"))
    doc = transcripts.select(key, "bucket", "job_key").join(audit.select(key, "status", "n_chunks", "n_lost"), key, "left")
    doc = doc.join(combined.drop("n_chunks"), key, "left").join(ents, key, "left")
    if entity_model is not None:
        doc = doc.join(failed, key, "left")
        status = F.when(F.col("_ner_failed"), F.lit("NER_FAILED")).otherwise(status)
    if rejected is not None:
        doc = doc.join(rejected.groupBy(key).agg(F.count(F.lit(1)).alias("n_rejected")), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return store_validation(
        doc.select(
            key, F.coalesce(status, F.lit("FAILED")).alias("status"), zero("n_chunks"), zero("n_lost"),
            zero("n_rejected") if rejected is not None else F.lit(0).cast("bigint").alias("n_rejected"),
            "transcript", "segments",
            F.coalesce("entities", F.create_map().cast("map<string,array<string>>")).alias("entities"),
            F.struct(F.col("bucket").alias("transcriptionOutputBucket"), F.col("job_key").alias("transcriptionJobName")).alias("s3"),
        )
    )
