"""Enrichment-span attributes folded onto one canonical namespace, and coverage counts.

Two vendor vocabularies name the same facts. All sources of a fact must agree in value
and type. Everything is decided inside the span's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocelens.functions.attributes import INTEGER, STRING, variant_value
from ocelens.operators.decode import ENVELOPE_CENSUS
from ocelens.operators.findings import failed_checks
from ocelens.vocabulary import CREDIT, Vocabulary

# Canonical keys and the vendor keys that carry them.
ALIASES = {
    "session.id": ("session.id", "gen_ai.conversation.id"),
    "model.name": ("llm.model_name", "gen_ai.request.model"),
    "model.provider": ("llm.provider", "gen_ai.provider.name"),
    "tokens.input": ("llm.token_count.prompt", "gen_ai.usage.input_tokens"),
    "tokens.output": ("llm.token_count.completion", "gen_ai.usage.output_tokens"),
    "tokens.total": ("llm.token_count.total",),
    "invocation.temperature": ("gen_ai.request.temperature",),
    "invocation.max_tokens": ("gen_ai.request.max_tokens",),
    "invocation.seed": ("gen_ai.request.seed",),
    "tool.name": ("tool.name", "gen_ai.tool.name"),
    "tool.description": ("tool.description", "gen_ai.tool.description"),
}
KIND_KEY = "openinference.span.kind"
OPERATION_KEY = "gen_ai.operation.name"
OPERATION_KINDS = {"chat": "LLM", "execute_tool": "TOOL", "tool": "TOOL"}
BLOB_KEY = "llm.invocation_parameters"
BLOB_FIELDS = {
    "invocation.temperature": "temperature",
    "invocation.max_tokens": "max_tokens",
    "invocation.seed": "seed",
}

# Keys kept as evidence without a canonical form, exact and by prefix.
RECORDED_KEYS = (
    "metadata",
    "gen_ai.input.messages",
    "gen_ai.output.messages",
    "gen_ai.tool.call.result",
    "gen_ai.tool.type",
)
RECORDED_PREFIXES = (
    "input.",
    "output.",
    "llm.input_messages.",
    "llm.output_messages.",
    "gen_ai.response.",
)

# Canonical keys a fully instrumented span of a kind carries.
EXPECTED_BY_KIND = {
    "LLM": (
        "session.id",
        "span.kind",
        "model.name",
        "model.provider",
        "invocation.temperature",
        "invocation.max_tokens",
        "tokens.input",
        "tokens.output",
        "tokens.total",
    ),
    "TOOL": ("session.id", "span.kind", "tool.name", "tool.description"),
    "CHAIN": ("session.id", "span.kind"),
}
_CONSUMED = sorted({a for names in ALIASES.values() for a in names} | {KIND_KEY, OPERATION_KEY, BLOB_KEY})
_TOKENS = ("tokens.input", "tokens.output", "tokens.total")


def _raw(key: str) -> Column:
    return F.col("attributes")[key]


def _as_string(value: Column) -> Column:
    return F.struct(F.lit(STRING).alias("kind"), value.alias("text"))


def _sources(canonical: str) -> Column:
    """All values a span offers for a canonical key."""
    values = [F.when(_raw(a).isNotNull(), _raw(a)) for a in ALIASES[canonical]]
    if canonical in BLOB_FIELDS:
        field = F.try_variant_get("_blob", f"$.{BLOB_FIELDS[canonical]}", "variant")
        present = field.isNotNull() & (F.schema_of_variant(field) != "VOID")
        other = F.struct(F.lit("other").alias("kind"), F.to_json(field).alias("text"))
        values.append(F.when(present, F.coalesce(variant_value(field), other)))
    return F.array_compact(F.array(*values))


def _kind_sources() -> Column:
    lookup = F.create_map(*[F.lit(x) for item in OPERATION_KINDS.items() for x in item])
    mapped = lookup[_raw(OPERATION_KEY)["text"]]
    return F.array_compact(
        F.array(
            F.when(_raw(KIND_KEY).isNotNull(), _as_string(_raw(KIND_KEY)["text"])),
            F.when(mapped.isNotNull(), _as_string(mapped)),
        )
    )


def normalise(spans: DataFrame) -> DataFrame:
    """Add kind, canonical (map), consumed, recorded, unknown, expected_present,
    expected_missing and failed (the names of the checks a span breaks)."""
    blob_text = F.when(_raw(BLOB_KEY)["kind"] == STRING, _raw(BLOB_KEY)["text"])
    rows = spans.withColumn("_blob", F.try_parse_json(blob_text))
    names = [*ALIASES, "span.kind"]
    rows = rows.withColumn(
        "_sources",
        F.struct(
            *[_sources(n).alias(n.replace(".", "_")) for n in ALIASES], _kind_sources().alias("span_kind")
        ),
    )
    src = {n: F.col("_sources")[n.replace(".", "_")] for n in names}
    first = {n: F.get(src[n], F.lit(0)) for n in names}
    tokens = {n: F.when(first[n]["kind"] == INTEGER, first[n]["text"].try_cast("bigint")) for n in _TOKENS}
    derived = tokens["tokens.input"] + tokens["tokens.output"]
    total = F.coalesce(
        F.when(
            derived.isNotNull(),
            F.struct(F.lit(INTEGER).alias("kind"), derived.cast("string").alias("text")),
        ),
        first["tokens.total"],
    )
    final = {**first, "tokens.total": total}
    entries = F.array_compact(
        F.array(
            *[
                F.when(final[n].isNotNull(), F.struct(F.lit(n).alias("key"), final[n].alias("value")))
                for n in sorted(names)
            ]
        )
    )
    conflict = None
    for n in names:
        here = F.size(F.array_distinct(src[n])) > 1
        conflict = here if conflict is None else conflict | here
    any_token = F.concat(*[src[n] for n in _TOKENS])
    every = F.concat(*[src[n] for n in names])
    blob_given = _raw(BLOB_KEY).isNotNull()
    checks = {
        "blob_not_an_object": blob_given
        & ~F.coalesce(F.schema_of_variant("_blob").startswith("OBJECT"), F.lit(False)),
        "value_not_representable": F.exists(every, lambda v: v["kind"] == "other"),
        "conflicting_sources": conflict,
        "token_not_integer": F.exists(any_token, lambda v: v["kind"] != INTEGER),
        "token_total": F.coalesce(derived != tokens["tokens.total"], F.lit(False)),
    }
    kind = F.coalesce(first["span.kind"]["text"], F.lit("UNKNOWN"))
    expected = F.create_map(
        *[
            x
            for k, keys in EXPECTED_BY_KIND.items()
            for x in (F.lit(k), F.array(*[F.lit(key) for key in sorted(keys)]))
        ]
    )
    wanted = F.coalesce(expected[F.col("kind_of_span")], F.array().cast("array<string>"))
    keys = F.map_keys("attributes")
    consumed = F.array(*[F.lit(k) for k in _CONSUMED])
    rest = F.array_except(keys, consumed)

    def is_recorded(k: Column) -> Column:
        out = k.isin(*RECORDED_KEYS)
        for prefix in RECORDED_PREFIXES:
            out = out | k.startswith(prefix)
        return out

    return (
        rows.withColumn("kind_of_span", kind)
        .withColumn("canonical", F.map_from_entries(entries))
        .withColumn("failed", failed_checks(checks))
        .withColumn("consumed", F.array_sort(F.array_intersect(keys, consumed)))
        .withColumn("recorded", F.array_sort(F.filter(rest, is_recorded)))
        .withColumn("unknown", F.array_sort(F.filter(rest, lambda k: ~is_recorded(k))))
        .withColumn("expected_present", F.array_intersect(wanted, F.map_keys("canonical")))
        .withColumn("expected_missing", F.array_except(wanted, F.map_keys("canonical")))
        .drop("_blob", "_sources")
    )


def normalise_findings(normalised: DataFrame) -> DataFrame:
    return normalised.select(
        F.explode("failed").alias("check_id"), F.col("source").alias("key"), F.col("span_id").alias("detail")
    )


def census_coverage(events: DataFrame, vocabulary: Vocabulary = CREDIT) -> DataFrame:
    """Required keys present per event type: (event_type, spans, present, total)."""
    census = F.create_map(
        *[
            x
            for kind in vocabulary.event_attributes
            for x in (
                F.lit(kind),
                F.array(
                    *[F.lit(k) for k in ENVELOPE_CENSUS],
                    *[F.lit(f"at.event.attr.{n}") for n in vocabulary.required_attributes(kind)],
                ),
            )
        ]
    )
    needed = census[F.col("event_type")]
    return events.groupBy("event_type").agg(
        F.count("*").alias("spans"),
        F.sum(F.size(F.array_intersect(needed, F.map_keys("attributes")))).alias("present"),
        F.sum(F.size(needed)).alias("total"),
    )


def kind_coverage(normalised: DataFrame) -> DataFrame:
    """Expected keys present per span kind: (kind, spans, present, total)."""
    return normalised.groupBy(F.col("kind_of_span").alias("kind")).agg(
        F.count("*").alias("spans"),
        F.sum(F.size("expected_present")).alias("present"),
        F.sum(F.size("expected_present") + F.size("expected_missing")).alias("total"),
    )


def key_counts(normalised: DataFrame) -> DataFrame:
    """Occurrences per key and bucket (missing, recorded, unknown)."""
    buckets = F.array(
        *[
            F.struct(F.lit(name).alias("bucket"), F.col(col).alias("keys"))
            for name, col in (
                ("missing", "expected_missing"),
                ("recorded", "recorded"),
                ("unknown", "unknown"),
            )
        ]
    )
    return (
        normalised.select(F.inline(buckets))
        .select("bucket", F.explode("keys").alias("key"))
        .groupBy("bucket", "key")
        .agg(F.count("*").alias("spans"))
    )


def mapped_fraction(census: DataFrame, kinds: DataFrame) -> DataFrame:
    """Present over required, both layers; 1.0 when nothing is required."""
    both = census.select("present", "total").unionAll(kinds.select("present", "total"))
    totals = both.agg(
        F.coalesce(F.sum("present"), F.lit(0)).alias("present"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
    )
    return totals.withColumn(
        "mapped_fraction", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("present") / F.col("total"))
    )
