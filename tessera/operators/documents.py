"""Text representations of records and documents: rendering, chunks, page spans, classification."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clipped, humanized

LEVELS = ("public", "internal", "confidential", "restricted")
RENDER_LIMIT, TRUNCATED = 4000, "...[truncated]"
CHUNK, OVERLAP, SEARCH, LEAST = 800, 100, 200, 40

# Document types with the words that tell them, words that rule them out, and weights.
CLASSES = (
    ("policy_document", ("policy", "policies", "procedure", "procedures", "guideline", "guidelines", "regulation", "compliance", "standard"), (), 1.2),
    ("invoice", ("invoice", "bill", "billing", "vat", "tax invoice"), ("policy", "procedure", "guideline"), 1.0),
    ("receipt", ("receipt", "proof of payment", "paid"), ("policy", "procedure"), 1.0),
    ("purchase_order", ("purchase order", "purchase-order", "po number", "order form"), ("policy", "procedure"), 1.0),
    ("approval_form", ("approval", "authorisation", "authorization", "sign-off", "form"), ("policy", "procedure"), 1.0),
    ("contract", ("contract", "agreement", "terms and conditions", "sla"), (), 1.0),
    ("statement", ("statement", "remittance", "reconciliation", "ledger"), (), 1.0),
)
UNCLASSIFIED = "unclassified_document"
NAME_WEIGHT, BODY_WEIGHT, BODY_CHARS = 3.0, 1.0, 2000


def most_sensitive(*declared: Column) -> Column:
    """The most restrictive of the levels declared; internal where none is."""
    rank = [F.array_position(F.array(*map(F.lit, LEVELS)), F.coalesce(d, F.lit("public"))) for d in declared]
    top = F.greatest(*rank, F.lit(0)) if len(rank) > 1 else rank[0]
    none = ~F.exists(F.array(*declared), lambda d: d.isNotNull())
    return F.when(none, "internal").otherwise(F.get(F.array(*map(F.lit, LEVELS)), (top - 1).cast("int")))


def rendered(entity: str, source: str | None, fields: dict[str, Column], limit: int = RENDER_LIMIT) -> Column:
    """Header, source and one ``Label: value`` line for each non-null field by sorted name."""
    lines = [F.lit(f"Entity: {entity}"), *([F.lit(f"Source: {source}")] if source else [])]
    lines += [F.when(v.isNotNull(), F.concat(humanized(F.lit(k)), F.lit(": "), v)) for k, v in sorted(fields.items())]
    return clipped(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n"), limit, TRUNCATED)


def classified(name: Column, body: Column) -> dict[str, Column]:
    """``kind``, ``best`` and ``confidence`` (best over all scores) by words in a document's name and first page."""
    page = F.lower(F.substring(body, 1, BODY_CHARS))
    scores = []
    for kind, words, against, weight in CLASSES:
        def has(text: Column, word: str) -> Column:
            return text.rlike(rf"\b{word}\b")

        hits = F.lit(0.0)
        for word in words:
            hits = hits + F.when(has(F.lower(name), word), NAME_WEIGHT).otherwise(0.0) + F.when(has(page, word), BODY_WEIGHT).otherwise(0.0)
        vetoed = F.lit(False)
        for word in against:
            vetoed = vetoed | has(F.lower(name), word) | has(page, word)
        scores.append(F.struct(F.when(vetoed, 0.0).otherwise(hits * weight).alias("score"), F.lit(-len(scores)).alias("turn"), F.lit(kind).alias("kind")))
    ranked = F.array(*scores)
    best = F.array_max(ranked)
    total = F.aggregate(F.transform(ranked, lambda s: s["score"]), F.lit(0.0), lambda a, b: a + b)
    return {"kind": F.when(best["score"] > 0, best["kind"]).otherwise(UNCLASSIFIED), "best": best["score"], "confidence": F.when(total > 0, F.round(best["score"] / total, 6)).otherwise(0.0)}


def fixed_chunks(docs: DataFrame, size: int = 1000, stride: int = 850) -> DataFrame:
    """(doc_id, chunk_no, chunk): windows of ``size`` characters every ``stride``."""
    starts = F.when(F.length("text") > 0, F.sequence(F.lit(0), F.length("text") - 1, F.lit(stride)))
    return docs.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start")).select("doc_id", "chunk_no", F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("chunk"))


def chunk_bounds(text: str, size: int = CHUNK, overlap: int = OVERLAP, search: int = SEARCH, least: int = LEAST) -> list[tuple[int, int]]:
    """Windows that end at a paragraph, sentence or word end where one lies in their last ``search`` characters."""
    bounds, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            low = max(start + least, end - search)
            for mark in ("\n\n", ". ", "\n", " "):
                at = text.rfind(mark, low, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        bounds.append((start, end))
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    if len(bounds) > 1 and bounds[-1][1] - bounds[-1][0] < least:
        bounds[-2:] = [(bounds[-2][0], bounds[-1][1])]
    return bounds


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, start, end, chunk): each window's start depends on its predecessor's end, hence Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, f"c{k:05d}", a, b, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for k, (a, b) in enumerate(chunk_bounds(t))]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "chunk_id", "start", "end", "chunk"), r, strict=True)) for r in rows], pa.schema([("doc_id", pa.int64()), ("chunk_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chunk", pa.string())]))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_id string, start long, end long, chunk string")
