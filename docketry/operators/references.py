"""References of all kinds of entities to evidence, from one declared registry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


@dataclass(frozen=True)
class Reference:
    """A kind of entity, the table and column of its ids, and the path to the evidence ids it cites."""

    kind: str
    table: str
    id: str
    path: str = "evidence_ids"


#: What cites evidence, and where it says so.
REGISTRY = (
    Reference("finding", "findings", "finding_id"),
    Reference("fact", "facts", "fact_id"),
    Reference("chunk", "chunks", "chunk_id"),
    Reference("attachment", "attachments", "reference_id"),
    Reference("hit", "traces", "trace_id", "hits.evidence_ids"),
    Reference("candidate", "candidates", "candidate_id"),
    Reference("assessment", "assessments", "assessment_id"),
    Reference("clause", "clauses", "clause_id"),
    Reference("obligation", "obligations", "obligation_id"),
    Reference("relation", "relations", "relation_id"),
    Reference("question", "questions", "question_id"),
    Reference("event", "events", "event_id"),
    Reference("comparison", "comparisons", "comparison_id"),
    Reference("change", "comparisons", "comparison_id", "changes.evidence_ids"),
    Reference("revision", "revisions", "revision_id", "changes.evidence_ids"),
    Reference("asked", "requests", "request_id", "candidates.evidence_ids"),
    Reference("answer", "responses", "response_id", "items.evidence_ids"),
)


def cited(path: str, kind: DataType, column: Column | None = None) -> Column:
    """The ids at a dotted path, as one array; arrays on the way are opened, nulls give nothing."""
    name, _, rest = path.partition(".")
    inner = kind[name].dataType
    value = F.col(name) if column is None else column[name]
    if not rest:
        ids = value if isinstance(inner, ArrayType) else F.array(value)
        return F.coalesce(ids, F.array().cast("array<string>"))
    if isinstance(inner, ArrayType):
        opened = F.transform(value, lambda x: cited(rest, inner.elementType, x))
        return F.coalesce(F.flatten(opened), F.array().cast("array<string>"))
    assert isinstance(inner, StructType)
    return cited(rest, inner, value)


def evidence_references(tables: Mapping[str, DataFrame], by: Sequence[str], registry: Iterable[Reference] = REGISTRY) -> DataFrame:
    """by, kind, id, evidence_id: what the given tables cite, each once. Kinds whose table is not given have none."""
    out = None
    for ref in registry:
        if ref.table not in tables:
            continue
        df = tables[ref.table]
        ids = F.array_distinct(cited(ref.path, df.schema))
        one = df.select(*by, F.lit(ref.kind).alias("kind"), F.col(ref.id).cast("string").alias("id"), F.explode(ids).alias("evidence_id"))
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("none of the registry's tables is given")
    return out


def dangling_references(tables: Mapping[str, DataFrame], evidence: DataFrame, by: Sequence[str], registry: Iterable[Reference] = REGISTRY) -> DataFrame:
    """by, kind, id, evidence_id of what is cited but is no evidence (by, evidence_id) of the same package: one union, one anti-join."""
    return evidence_references(tables, by, registry).join(evidence.select(*by, "evidence_id").distinct(), [*by, "evidence_id"], "left_anti")
