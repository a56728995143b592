"""Shared shape of the rule jobs.

Every rule marks the field rows that decide it; the first deciding one in the rule's order
(its fields, then documents, then field names) wins. Field rows are dealt out by application
once. There all rules are counted in one aggregate per (application, rule), which keeps numbers
only, and meet the rows that decide for their texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import vocab
from dossier.functions.lit import blank, strip

PASS, FAIL, WARNING, PENDING = vocab.RULE_STATUSES



class Verdict(NamedTuple):
    """When a field row decides its rule, and (status, message) of a row that does."""

    decides: Column
    found: Column


class ValueRule(NamedTuple):
    """A rule over field values.

    ``fields`` empty means every field; ``document_type`` None means every type.
    """

    rule_id: str
    rule_name: str
    category: str
    fields: tuple[str, ...]
    document_type: str | None
    verdict: Verdict | None
    passed: str
    related: tuple[str, ...]


def verdict(*arms: tuple[Column, str, Column]) -> Verdict:
    """Verdict of the first true test of the (test, status, message) arms."""
    found, decides = None, F.lit(False)
    for test, status, text in arms:
        made = F.struct(F.lit(status).alias("status"), text.alias("message"))
        found = F.when(test, made) if found is None else found.when(test, made)
        decides = decides | F.coalesce(test, F.lit(False))
    return Verdict(decides, found)


def with_values(fields: DataFrame) -> DataFrame:
    """Field rows as the rules see them: stale values hidden, trimmed value and flags added."""
    stale = F.col("verification_status").isin(*vocab.UNVERIFIED_STATUSES)
    nv = F.when(~F.coalesce(stale, F.lit(False)), F.col("normalized_value"))
    trimmed = fields.select(
        "application_id",
        "document_id",
        F.coalesce("document_type", F.lit(vocab.UNKNOWN)).alias("document_type"),
        "field_name",
        "extracted_value",
        blank(F.col("extracted_value")).alias("empty"),
        "confidence_score",
        nv.alias("nv"),
        strip(F.coalesce(nv, F.lit(""))).alias("v"),
    )
    return trimmed.withColumn("present", F.col("v") != "")


def deal_out(values: DataFrame, rules: Sequence[ValueRule]) -> DataFrame:
    """The values that some rule reads, by application: those without one decide nothing.

    What follows from the stored value is made again behind the shuffle, not carried over it.
    """
    kind = F.col("document_type")
    read = F.exists(_readers(rules), lambda r: r["kind"].isNull() | (r["kind"] == kind))
    rows = values.filter(F.col("application_id").isNotNull() & F.coalesce(read, F.lit(False)))
    dealt = rows.drop("v", "present").repartition("application_id")
    trimmed = dealt.withColumn("v", strip(F.coalesce("nv", F.lit(""))))
    return trimmed.withColumn("present", F.col("v") != "")


def _readers(rules: Sequence[ValueRule]) -> Column:
    """The rules that read a field of this row's name, found by one lookup."""
    spots = [(no, i, n, r.document_type) for no, r in enumerate(rules) for i, n in enumerate(r.fields or (None,))]
    kind = "array<struct<rule_no:int,spot:int,kind:string>>"

    def listed(of: list) -> Column:
        cells = [F.struct(F.lit(no).alias("rule_no"), F.lit(i).alias("spot"), F.lit(t).cast("string").alias("kind")) for no, i, _, t in of]
        return F.array(*cells).cast(kind)

    always = [s for s in spots if s[2] is None]
    names = dict.fromkeys(s[2] for s in spots if s[2] is not None)
    table = F.create_map(*[x for n in names for x in (F.lit(n), listed([s for s in spots if s[2] in (n, None)]))])
    return F.coalesce(F.try_element_at(table, F.col("field_name")), listed(always))


def candidates(values: DataFrame, rules: Sequence[ValueRule]) -> DataFrame:
    """Field rows paired with the rules that read them, as (rule_no, spot in the rule).

    One lookup by field name gives the rules of a row, instead of a test for each rule.
    """
    paired = values.withColumn("_r", F.explode(_readers(rules)))
    right_type = F.col("_r.kind").isNull() | (F.col("_r.kind") == F.col("document_type"))
    return paired.filter(right_type).select(*values.columns, "_r.rule_no", "_r.spot")


def _by_rule(rules: Sequence[ValueRule], value, kind: str) -> Column:
    """``value(verdict)`` of the row's rule, null for rules that no row decides; rules over
    every field are looked at first."""
    named = sorted(enumerate(rules), key=lambda x: len(x[1].fields) > 0)
    found = None
    for no, rule in named:
        if rule.verdict is not None:
            arm = F.col("rule_no") == no
            made = value(rule.verdict)
            found = F.when(arm, made) if found is None else found.when(arm, made)
    return F.lit(None).cast(kind) if found is None else found


def rule_counts(values: DataFrame, rules: Sequence[ValueRule]) -> DataFrame:
    """Per (application, rule): rows read, those with a value, and the first deciding field
    (``spot``) with the smallest document that it decides.

    Numbers only, so Spark aggregates by hash, however many rows an application has.
    """
    width = max(len(r.fields or (None,)) for r in rules)
    decided = F.coalesce(_by_rule(rules, lambda v: v.decides, "boolean"), F.lit(False))
    slim = candidates(values, rules).select(
        "application_id",
        "rule_no",
        "present",
        (F.coalesce("nv", F.lit("")) != "").alias("filled"),
        F.when(decided, F.col("document_id")).alias("document_id"),
        "spot",
    )
    counts = slim.groupBy("application_id", "rule_no").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("present").alias("n_present"),
        F.count_if("filled").alias("n_filled"),
        *[F.min(F.when(F.col("spot") == i, F.col("document_id"))).alias(f"doc_{i}") for i in range(width)],
    )
    first = F.coalesce(
        *[F.when(F.col(f"doc_{i}").isNotNull(), F.struct(F.lit(i).alias("spot"), F.col(f"doc_{i}").alias("document_id"))) for i in range(width)]
    )
    return counts.select("application_id", "rule_no", "n_rows", "n_present", "n_filled", first.alias("d")).select(
        "application_id", "rule_no", "n_rows", "n_present", "n_filled", "d.spot", "d.document_id"
    )


def first_verdicts(values: DataFrame, counts: DataFrame, rules: Sequence[ValueRule]) -> DataFrame:
    """The counts per (application, rule) with what the row says that decides it, null where
    none does. Messages are written for the rows of the deciding documents alone.

    Both tables lie by application, so nothing is shuffled, and the numbers are hashed.
    """
    decided = F.coalesce(_by_rule(rules, lambda v: v.decides, "boolean"), F.lit(False))
    rows = candidates(values, rules).filter(decided)
    spots = counts.select(
        "application_id", "rule_no", "n_rows", "n_present", "n_filled",
        F.col("document_id").alias("_doc"), F.col("spot").alias("_spot"),
        F.col("application_id").alias("_app"), F.col("rule_no").alias("_no"),
    ).drop("application_id", "rule_no")
    # Null-safe, so that both readers of the values take the same rows and share their shuffle.
    same = (F.col("_app") == F.col("application_id")) & (F.col("_no") == F.col("rule_no"))
    here = F.col("_doc").eqNullSafe(F.col("document_id")) & (F.col("_spot") == F.col("spot"))
    found = _by_rule(rules, lambda v: F.when(v.decides, v.found), "struct<status:string,message:string>")
    said = spots.hint("shuffle_hash").join(rows, same & here, "left").select(
        F.col("_app").alias("application_id"), F.col("_no").alias("rule_no"),
        "n_rows", "n_present", "n_filled", "document_id", "field_name", found.alias("found"),
    )
    order = F.when(F.col("found").isNotNull(), F.col("field_name"))
    return said.groupBy("application_id", "rule_no").agg(
        *[F.max(n).alias(n) for n in ("n_rows", "n_present", "n_filled")],
        F.min_by(F.struct("found.status", "found.message", "document_id", "field_name"), order).alias("first"),
    )


def every_rule(apps: DataFrame, rules: Iterable[tuple], key: str, *found: DataFrame) -> DataFrame:
    """Applications with a row per rule (id, name, category first in each tuple), and what was
    found for it: the columns of each of ``found``, which holds an (application, ``key``) once.

    What was found meets its application as one map, bounded by the number of rules, and the
    rows of the rules are made after that join, so that they are never shuffled.
    """
    tagged = None
    for i, rows in enumerate(found):
        held = [c for c in rows.columns if c not in ("application_id", key)]
        part = rows.select("application_id", F.struct(key, F.struct(*held).alias("held")).alias(f"_e{i}"))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
    maps = [F.map_from_entries(F.collect_list(f"_e{i}")).alias(f"_m{i}") for i in range(len(found))]
    per_app = tagged.groupBy("application_id").agg(*maps)
    cells = [
        F.struct(
            F.lit(r[0]).alias("rule_id"),
            F.lit(r[1]).alias("rule_name"),
            F.lit(r[2]).alias("rule_category"),
            F.lit(no).alias("rule_no"),
        )
        for no, r in enumerate(rules)
    ]
    rows = apps.join(per_app, "application_id", "left").select(
        *apps.columns, *[f"_m{i}" for i in range(len(found))], F.explode(F.array(*cells)).alias("r")
    )
    hits = [F.try_element_at(f"_m{i}", F.col(f"r.{key}")).alias(f"_h{i}") for i in range(len(found))]
    return rows.select(*apps.columns, "r.*", *hits).select(
        *apps.columns,
        *("rule_id", "rule_name", "rule_category", "rule_no"),
        *[f"_h{i}.*" for i in range(len(found))],
    )


RESULT_COLUMNS = (
    "application_id",
    "rule_id",
    "rule_name",
    "rule_category",
    "status",
    "message",
    "deciding_document_id",
    "has_related_documents",
    "related_field_names",
)


def text_array(names: Iterable[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def pick(rules: Iterable, value) -> Column:
    """Constant per rule id, as a lookup over the ``rule_id`` column."""
    pairs = [x for r in rules for x in (F.lit(r.rule_id), value(r))]
    return F.try_element_at(F.create_map(*pairs), F.col("rule_id"))
