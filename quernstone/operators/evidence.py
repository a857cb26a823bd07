"""Evidence cards checked against their sources, and results against the plan they were bound to.

A card names a source, its content's SHA-256 and a place in it. A source meets the set
of places that its cards name and is parsed once into what is there (lines, JSON nodes,
the number of CSV records), which the cards meet by equality: no source is read again
for a card, and no card carries a source's content.
"""

from __future__ import annotations

import contextlib
import csv
import io
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LINE_ENDS, squeeze
from ..session import SLICE_ROWS

#: Kinds of place; the last four only have to be there.
LOCATORS = ("json_pointer", "line_range", "csv_row", "text_span", "image", "pdf_pages", "video_frames")
UNREAD = LOCATORS[3:]
#: How evidence may support a claim.
DIRECTNESS = ("direct", "derived", "source_stated")
#: What a verified card has to say.
CARD_FIELDS = ("claim", "source", "unit_id", "independence_group", "family_id", "lane", "directness")


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical(value: Any) -> str:
    return _ENCODER.encode(value)


def _node(value: Any, pointer: str) -> str | None:
    """Canonical text of the node that pointer names, None if there is none."""
    if pointer and not pointer.startswith("/"):
        return None
    for token in pointer.split("/")[1:]:
        if isinstance(value, dict):
            key = token.replace("~1", "/").replace("~0", "~")
            # one spelling names a node
            if key not in value or key.replace("~", "~0").replace("/", "~1") != token:
                return None
            value = value[key]
        elif isinstance(value, list):
            if not (token.isascii() and token.isdigit() and len(token) < 19 and str(int(token)) == token and int(token) < len(value)):
                return None
            value = value[int(token)]
        else:
            return None
    return canonical(value)


_PARSED = pa.struct([("nodes", pa.list_(pa.string())), ("records", pa.int64())])


@F.arrow_udf(T.StructType([T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("records", T.LongType())]))
def _parsed(bodies: pa.Array, asks_csv: pa.Array, pointers: pa.Array) -> pa.Array:
    """Per source the JSON node of each of its pointers and the number of its CSV records; null where it can't be read so or isn't asked."""
    parts = []
    for at in range(0, max(len(bodies), 1), SLICE_ROWS):
        out = []
        for body, asks, wanted in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in (bodies, asks_csv, pointers)), strict=True):
            nodes = records = None
            if body is not None and wanted:
                with contextlib.suppress(ValueError, RecursionError):
                    value = json.loads(body)
                    nodes = [None if pointer is None else _node(value, pointer) for pointer in wanted]
            if body is not None and asks:
                with contextlib.suppress(ValueError, csv.Error, RecursionError):
                    records = sum(1 for _ in csv.DictReader(io.StringIO(body, newline="")))
            out.append({"nodes": nodes, "records": records})
        parts.append(pa.array(out, _PARSED))
    return pa.concat_arrays(parts)


def _place(cards: DataFrame) -> DataFrame:
    """cards with _place: what of its source a card has to see beside the source's figures."""
    kind = F.col("kind")
    lines = (kind == "line_range") & (F.trim(F.coalesce("quote", F.lit(""))) != "") & F.col("first").isNotNull() & F.col("last").isNotNull()
    name = F.when(kind == "json_pointer", F.concat(F.lit("node "), F.coalesce("pointer", F.lit("")))).when(lines, F.concat_ws(" ", F.lit("lines"), F.col("first").cast("string"), F.col("last").cast("string")))
    return cards.withColumn("_place", F.coalesce(name, F.lit("")))


def _seen(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, _place, value, actual, decoded, lines, records) for each place that cards name, and for the place "" of each of their sources.

    value is the node's canonical text or the lines' without white space. A source meets the set of its places, and is
    hashed, split and parsed there once; its content goes no further.
    """
    kind, named = F.col("kind"), F.col("_place") != ""
    wanted = _place(cards).groupBy("source").agg(
        F.collect_set(F.when(named, F.struct("_place", F.when(kind == "json_pointer", F.coalesce("pointer", F.lit(""))).alias("pointer"), "first", "last"))).alias("places"),
        *(F.coalesce(F.bool_or(kind == k), F.lit(False)).alias(name) for k, name in (("json_pointer", "asks_json"), ("line_range", "asks_lines"), ("csv_row", "asks_csv"))),
    )
    text = F.col("content").cast("string")
    body = F.when(F.is_valid_utf8(text), F.when(F.startswith(text, F.lit("\ufeff")), F.substr(text, F.lit(2))).otherwise(text))
    # each column is bound by a projection of its own, so that it is computed once
    met = sources.select("source", "content").join(wanted, "source").withColumn("_body", body).withColumn("_lines", F.split(F.when(F.col("asks_lines"), F.col("_body")), LINE_ENDS))
    # a text that ends with a line's end has no further line, an empty one has none
    met = met.select(
        "source", "places", "asks_csv", "_lines", F.sha2("content", 256).alias("actual"), F.col("_body").isNotNull().alias("decoded"),
        (F.size("_lines") - F.when(F.get("_lines", F.size("_lines") - 1) == "", 1).otherwise(0)).cast("long").alias("_count"),
        F.when(F.col("asks_csv") | F.col("asks_json"), F.col("_body")).alias("_unparsed"),
    ).withColumn("lines", F.when(F.col("_lines").isNotNull(), F.col("_count")))

    def held(r: Column) -> Column:
        sound = (r["first"] >= 1) & (r["last"] >= r["first"]) & (r["last"] <= F.col("lines"))
        return F.when(sound, squeeze(F.array_join(F.slice("_lines", r["first"].cast("int"), (r["last"] - r["first"] + 1).cast("int")), "")))

    unit = lambda place, value: F.struct(place.alias("_place"), value.cast("string").alias("value"))
    pointers = F.when(F.col("_unparsed").isNotNull(), F.transform("places", lambda x: x["pointer"]))
    spans = F.when(F.col("_lines").isNotNull(), F.transform("places", lambda x: F.when(x["pointer"].isNull(), held(x))))
    read = met.select("source", "actual", "decoded", "lines", "places", spans.alias("_spans"), _parsed("_unparsed", "asks_csv", pointers).alias("_parsed"))
    units = F.transform("places", lambda x, k: unit(x["_place"], F.coalesce(F.get(F.col("_parsed.nodes"), k), F.get(F.col("_spans"), k))))
    return read.select("source", "actual", "decoded", "lines", F.col("_parsed.records").alias("records"), F.inline(F.concat(F.array(unit(F.lit(""), F.lit(None))), units)))


def card_errors(cards: DataFrame, sources: DataFrame) -> DataFrame:
    """(evidence_id, error): why cards that claim to be verified aren't; cards without an error hold.

    cards: evidence_id, the CARD_FIELDS, verified, source_sha256, kind, pointer, expected (JSON text), first, last, quote,
    row; sources: source and content (binary, UTF-8). Ids are checked for being there and unique.
    """
    said = F.struct(*(c for c in cards.columns if c != "evidence_id"))
    told = cards.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("_times"), F.first(F.when(F.col("verified"), said), ignorenulls=True).alias("_card"))
    seen = _seen(cards.filter("verified"), sources)
    met = _place(told.select("evidence_id", "_times", F.col("_card").isNotNull().alias("_told"), "_card.*")).join(seen, ["source", "_place"], "left")
    there, kind = F.col("actual").isNotNull(), F.col("kind")
    declared = F.lower(F.trim(F.coalesce("source_sha256", F.lit(""))))
    hashed = declared.rlike("^[0-9a-f]{64}$")
    error = lambda name, broken: F.when(F.coalesce(broken, F.lit(False)), F.lit(name))

    def placed() -> Column:
        unread = ~F.col("decoded") & ~kind.isin(*UNREAD)
        json_place = F.when(F.col("value").isNull(), "locator_unresolvable").when(F.col("expected").isNotNull() & (F.col("value") != F.col("expected")), "locator_expected_mismatch")
        lines = F.when(F.col("first").isNull() | F.col("last").isNull(), "locator_unresolvable").when((F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > F.col("lines")), "locator_line_range_invalid").when(~F.contains("value", squeeze(F.col("quote"))), "locator_quote_mismatch")
        rows = F.when(F.col("row").isNull() | F.col("records").isNull(), "locator_unresolvable").when((F.col("row") < 1) | (F.col("row") > F.col("records")), "locator_csv_row_invalid")
        return F.when(kind.isNull(), "locator_missing").when(~kind.isin(*LOCATORS), "locator_type_invalid").when(unread, "locator_unresolvable").when(kind == "json_pointer", json_place).when(kind == "line_range", lines).when(kind == "csv_row", rows)

    checks = [error(f"{c}_missing", F.trim(F.coalesce(F.col(c), F.lit(""))) == "") for c in CARD_FIELDS] + [
        error("directness_invalid", ~F.coalesce(F.col("directness").isin(*DIRECTNESS), F.lit(False))), error("source_file_missing", ~there),
        error("source_sha256_missing_or_invalid", there & ~hashed), error("source_sha256_mismatch", there & hashed & (declared != F.col("actual"))), F.when(there, placed()),
    ]
    blank = F.trim(F.coalesce("evidence_id", F.lit(""))) == ""
    by_id = F.when(blank, "id_missing").when(F.col("_times") > 1, "id_duplicated")
    found = F.array_compact(F.array(by_id, *(F.when(F.col("_told"), c) for c in checks)))
    return met.select("evidence_id", F.explode(found).alias("error"))


#: What a result's binding and the plan's target must agree on, by layer; "a=b" is a of the binding and b of the target.
BOUND_FIELDS = {
    "heterogeneity": "target outcome_field method=planned_method analysis_unit validation_type segment_field group_field group_a group_b minimum_group_n effect_scope design_evidence_refs",
    "mechanism": "target outcome_field method=planned_method analysis_unit validation_type mechanism_id mechanism_variable changed_or_isolated_variable baseline_hypothesis_id candidate_hypothesis_id required_granularity evaluation_window measurement hypothesis_predictions",
    "predictive": "target outcome_field method=planned_method analysis_unit validation_type validation_design=validation time_field horizon horizon_steps horizon_unit cutoff cutoff_mode metric baseline_model baseline_kind baseline_model_id minimum_history minimum_improvement model_specs uncertainty_method confidence_level bootstrap_replicates bootstrap_seed block_length minimum_origins",
    "causal": "target outcome_field method=planned_method intervention comparator group_field intervention_value comparator_value identification_strategy design_evidence_refs",
}


def binding_mismatches(bindings: DataFrame, values: DataFrame, targets: DataFrame, fields: dict[str, str] | None = None) -> DataFrame:
    """(evidence_id, field): where a result is bound to something else than the plan's target of its layer.

    bindings: evidence_id, layer; values: evidence_id, field, value (canonical JSON); targets: layer, field, value. A layer
    without a target gives ``analysis_target``. What neither side states agrees.
    """
    pairs = [(layer, *(f.split("=") * 2)[:2]) for layer, names in (fields or BOUND_FIELDS).items() for f in names.split()]
    rules = F.explode(F.array(*(F.struct(F.lit(x).alias("layer"), F.lit(a).alias("field"), F.lit(b).alias("planned")) for x, a, b in pairs)))
    wanted = bindings.sparkSession.range(1).select(rules.alias("r")).select("r.*")
    known = targets.select("layer").distinct()
    lost = bindings.join(known, "layer", "left_anti").select("evidence_id", F.lit("analysis_target").alias("field"))
    asked = bindings.join(known, "layer").join(F.broadcast(wanted), "layer")
    plan = targets.select("layer", F.col("field").alias("planned"), F.col("value").alias("_planned"))
    met = asked.join(values.select("evidence_id", "field", F.col("value").alias("_stated")), ["evidence_id", "field"], "left").join(plan, ["layer", "planned"], "left")
    return lost.unionByName(met.filter(~F.col("_stated").eqNullSafe(F.col("_planned"))).select("evidence_id", "field"))
