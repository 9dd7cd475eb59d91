"""Which category template does each record belong to?

Scoring depends only on *which* known field names a record carries, and catalogues repeat the same few name sets
over millions of products.  So each record is reduced to a signature (its known names, sorted), every distinct
signature is scored once against the templates, and the answer is joined back by signature.  The work of
records x templates x fields becomes distinct signatures x templates.

Ties are never decided by order: a tie is broken by a size or by exactly one telling word, or it stays a tie.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.aliases import alias_table
from ..functions.measures import single_axis_length, size_mm
from ..session import cut_lineage, settle

# Thresholds of a match and length of a candidate list.
MIN_PRECISION = 0.5
MIN_RECALL = 0.5
TOP_CANDIDATES = 8
# Reasons given for an open decision.
TIE_REASON = "unresolved tie among %d candidates at precision %.3f"
NO_MATCH_REASON = "no schema cleared the match/recall thresholds"


# ---------------------------------------------------------------- template side (small tables)

def writable(fields: DataFrame) -> DataFrame:
    """Fields a user fills in: not locked, no formula, not reserved for a manual step."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return fields.filter(~flag("locked") & ~flag("is_formula") & ~t.never_populate(F.col("name")))


def required_writable(fields: DataFrame) -> DataFrame:
    """Required fields that evidence can cover; commercial fields are never stated by a supplier page."""
    return writable(fields).filter(F.coalesce(F.col("required"), F.lit(False)) & ~t.is_commercial(F.col("section")))


def _targets(fields: DataFrame) -> DataFrame:
    """One row per template and canonical name; a later field of the same canonical name replaces an earlier one."""
    needed = required_writable(fields).groupBy("template_id", "name").agg(F.count("*").alias("required_rows"))
    named = writable(fields).withColumn("canon", t.canonical(F.col("name")))
    last = named.groupBy("template_id", "canon").agg(F.max_by("name", "field_ord").alias("name"))
    return last.join(needed, ["template_id", "name"], "left").fillna(0, ["required_rows"])


def field_routes(fields: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Where an observed name leads in each template: (template_id, canon, has_length) to one field.

    A direct name wins over an alias; among aliases the first listed whose condition holds and whose target is a
    field of this very template (exact spelling) wins.  ``has_length`` says whether the observed value is a length
    along one axis, the only condition an alias can carry.
    """
    aliases = alias_table(fields.sparkSession) if aliases is None else aliases
    targets = _targets(fields)
    direct = targets.select(
        "template_id", "canon", F.lit(-1).alias("priority"), F.lit(False).alias("needs_length"),
        F.col("canon").alias("field_canon"), "name", "required_rows",
    )
    renamed = targets.join(aliases, targets["name"] == aliases["target"]).select(
        "template_id", t.alias_key(F.col("alias")).alias("canon"), F.col("alias_ord").alias("priority"),
        "needs_length", F.col("canon").alias("field_canon"), "name", "required_rows",
    )
    both = direct.unionByName(renamed).withColumn("has_length", F.explode(F.array(F.lit(False), F.lit(True))))
    best = F.struct("field_canon", "name", "required_rows", (F.col("priority") < 0).alias("direct"))
    return (
        both.filter(~F.col("needs_length") | F.col("has_length"))
        .groupBy("template_id", "canon", "has_length")
        .agg(F.min_by(best, "priority").alias("r"))
        .select("template_id", "canon", "has_length", "r.*")
    )


def resolve_alias(names: DataFrame, available: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``target``: the field of ``group_id`` an observed (name, value) stands for, else the name itself.

    ``names`` has (group_id, name, value) and ``available`` the (group_id, field) names that may be targeted.
    """
    aliases = alias_table(names.sparkSession) if aliases is None else aliases
    options = (
        available.select("group_id", "field").distinct()
        .join(aliases, F.col("field") == F.col("target"))
        .select("group_id", t.alias_key(F.col("alias")).alias("alias_key"), "alias_ord", "needs_length", "target")
        .withColumn("has_length", F.explode(F.array(F.lit(False), F.lit(True))))
        .filter(~F.col("needs_length") | F.col("has_length"))
        .groupBy("group_id", "alias_key", "has_length")
        .agg(F.min_by("target", "alias_ord").alias("alias_target"))
    )
    keyed = names.withColumn("alias_key", t.alias_key(F.col("name"))).withColumn(
        "has_length", single_axis_length(F.col("value"))
    )
    joined = keyed.join(settle(options), ["group_id", "alias_key", "has_length"], "left")
    return joined.withColumn("target", F.coalesce("alias_target", "name")).drop(
        "alias_key", "has_length", "alias_target"
    )


@dataclass
class TemplateIndex:
    """Everything the record side looks up in the templates, computed once and kept as small tables."""

    templates: DataFrame  # template_id, template_ord, category_path
    fields: DataFrame  # writable fields with canonical names and prepared vocabularies
    routes: DataFrame  # observed name -> field, per template
    known: DataFrame  # names any template can use
    known_again: DataFrame  # names any template can use directly
    required: DataFrame  # template_id, n_required, required_names in field order
    leaf_clues: DataFrame  # words and sizes of the last path parts


def index_templates(templates: DataFrame, fields: DataFrame, aliases: DataFrame | None = None) -> TemplateIndex:
    """Prepare the template side once; each table is written, so joins are planned by its real size."""
    routes = settle(field_routes(fields, aliases))
    form = writable(fields).select(
        "template_id", t.canonical(F.col("name")).alias("field_canon"), "field_ord", "name",
        F.coalesce("required", F.lit(False)).alias("required"), "type", "vocabulary",
        F.transform("vocabulary", F.lower).alias("vocabulary_lower"),
        F.transform("vocabulary", padded).alias("vocabulary_padded"),
    )
    return TemplateIndex(
        templates=settle(templates.select("template_id", "template_ord", "category_path")),
        fields=settle(form),
        routes=routes,
        known=settle(routes.select("canon").distinct().withColumn("known", F.lit(True))),
        known_again=settle(
            routes.filter("direct").select(F.col("canon").alias("again")).distinct()
            .withColumn("known_again", F.lit(True))
        ),
        required=settle(required_writable(fields).groupBy("template_id").agg(
            F.count("*").alias("n_required"), F.array_sort(F.collect_list(F.struct("field_ord", "name"))).alias("r"),
        ).select("template_id", "n_required", F.transform("r", lambda x: x["name"]).alias("required_names"))),
        leaf_clues=settle(templates.select(F.explode(_leaf_clues(F.element_at("category_path", -1))).alias("clue")).distinct()),
    )


def padded(c: Column) -> Column:
    """Vocabulary text with a space at both ends, so whole words can be found by plain containment."""
    return F.concat(F.lit(" "), t.vocabulary_text(c), F.lit(" "))


# ---------------------------------------------------------------- evidence side

def _first_values(evidence: DataFrame) -> DataFrame:
    """First value per record and canonical name; rows that are no attribute keep their record alive as ``canon`` null."""
    usable = (F.coalesce(F.col("field"), F.lit("")) != "") & t.candidate_attribute(F.col("canon"), F.col("value"))
    return (
        evidence.select("record_id", "field", t.canonical(F.col("field")).alias("canon"), "value", "seq")
        .select("record_id", F.when(usable, F.col("canon")).alias("canon"), "value", "seq")
        .groupBy("record_id", "canon")
        .agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    )


def evidence_map(evidence: DataFrame) -> DataFrame:
    """Distinct candidate fields per record with their first value; blanks and absences count as seen."""
    return _first_values(evidence).filter(F.col("canon").isNotNull())


def record_signatures(evidence: DataFrame, index: TemplateIndex, first: DataFrame | None = None) -> DataFrame:
    """One row per record: number of distinct fields and the sorted set of names any template knows.

    The set is bounded by the number of names in the templates, whatever the record holds.  ``first`` is what
    :func:`_first_values` gives, where it is there already.
    """
    named = (
        (_first_values(evidence) if first is None else first)
        .withColumn("again", t.canonical(F.col("canon")))
        .join(index.known, "canon", "left")
        .join(index.known_again, "again", "left")
    )
    # Only the values of known names are looked at.
    item = F.concat_ws("\x1f", "canon", "again", single_axis_length(F.col("value")).cast("string"))
    return named.groupBy("record_id").agg(
        F.count("canon").alias("n_fields"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("known") | F.col("known_again"), item))), "\x1e"
        ).alias("signature"),
    )


def score_signatures(signatures: DataFrame, index: TemplateIndex) -> DataFrame:
    """Signature x overlapping template: matched names, required names covered and wanted, matched fields.

    Templates sharing no name with a signature are left out; their score is zero and they can never win.
    """
    parts = F.split("item", "\x1f")
    items = (
        signatures.select("signature").distinct()
        .withColumn("item", F.explode(F.split("signature", "\x1e")))
        .filter("item <> ''")
        .select(
            "signature", "item", (parts[2] == "true").alias("has_length"),
            F.explode(
                F.when(parts[0] == parts[1], F.array(F.struct(parts[0].alias("canon"), F.lit(0).alias("turn"))))
                .otherwise(F.array(
                    F.struct(parts[0].alias("canon"), F.lit(0).alias("turn")),
                    F.struct(parts[1].alias("canon"), F.lit(1).alias("turn")),
                ))
            ).alias("look"),
        )
        .select("signature", "item", "has_length", "look.*")
    )
    hits = (
        items.join(index.routes, ["canon", "has_length"])
        .filter("turn = 0 OR direct")
        .groupBy("signature", "template_id", "item")
        .agg(F.min_by(F.struct("name", "required_rows"), "turn").alias("hit"))
    )
    names = F.array_sort(F.transform("hits", lambda h: h["name"]))
    required = F.coalesce("required_names", F.array().cast("array<string>"))
    return (
        hits.groupBy("signature", "template_id")
        .agg(F.count("*").alias("matched"), F.collect_set("hit").alias("hits"))
        .join(index.required, "template_id", "left")
        .select(
            "signature", "template_id", "matched",
            F.coalesce("n_required", F.lit(0)).alias("n_required"),
            F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, h: a + h["required_rows"]).alias("n_covered"),
            names.alias("matched_fields"),
            F.filter(required, lambda r: F.array_contains(names, r)).alias("required_present"),
            F.filter(required, lambda r: ~F.array_contains(names, r)).alias("required_missing"),
        )
    )


@dataclass
class Scored:
    """Every record with its signature, and every distinct signature with its templates."""

    records: DataFrame  # record_id, n_fields, signature
    scores: DataFrame  # signature, template_id, matched, n_required, n_covered and lists of names


def score_records(evidence: DataFrame, index: TemplateIndex) -> Scored:
    """What every question about scores starts from; both tables are written."""
    records = cut_lineage(record_signatures(evidence, index))
    return Scored(records, settle(score_signatures(records, index)))


def _recall(n_required: Column, n_covered: Column) -> Column:
    return F.when(n_required > 0, n_covered / n_required).otherwise(F.lit(0.0))


def score_templates(evidence: DataFrame, index: TemplateIndex, scored: Scored | None = None) -> DataFrame:
    """Record x overlapping template with precision and recall, and which required names are there or missing."""
    scored = scored or score_records(evidence, index)
    return scored.records.join(scored.scores, "signature").select(
        "record_id", "template_id", "n_fields", "matched", (F.col("matched") / F.col("n_fields")).alias("precision"),
        "n_required", "n_covered", _recall(F.col("n_required"), F.col("n_covered")).alias("recall"), "matched_fields",
        "required_present", "required_missing",
    )


def gate_counts(scored: Scored, min_recall: float = MIN_RECALL) -> DataFrame:
    """(template_id, passed, failed): records whose gate each template passes; counted over signatures, not records."""
    bearers = scored.records.groupBy("signature").agg(F.count("*").alias("n"))
    gate = recall_gate(F.col("n_required"), F.col("n_covered"), min_recall)
    return scored.scores.join(bearers, "signature").groupBy("template_id").agg(
        F.sum(F.when(gate, F.col("n")).otherwise(0)).alias("passed"), F.sum(F.when(gate, 0).otherwise(F.col("n"))).alias("failed"))


def recall_gate(n_required: Column, n_covered: Column, min_recall: float = MIN_RECALL) -> Column:
    """True when nothing is required, or enough of what is required is covered."""
    return (n_required == 0) | (n_covered / F.greatest(n_required, F.lit(1)) >= min_recall)


def signature_tiers(scores: DataFrame, min_recall: float = MIN_RECALL) -> DataFrame:
    """Per signature: best match count seen, best one passing the gate, and the templates sharing that best.

    The denominator of precision belongs to the record, so equal counts are equal precisions and no floating-point
    comparison is needed.  The array holds at most every template once.
    """
    passed = recall_gate(F.col("n_required"), F.col("n_covered"), min_recall)
    agg = scores.groupBy("signature").agg(
        F.max("matched").alias("best_seen"),
        F.max(F.when(passed, F.col("matched"))).alias("best_passed"),
        F.collect_list(F.when(passed, F.struct("matched", "template_id"))).alias("open"),
    )
    top = F.filter("open", lambda c: c["matched"] == F.col("best_passed"))
    return agg.select(
        "signature", "best_seen", "best_passed", F.array_sort(F.transform(top, lambda c: c["template_id"])).alias("tier")
    )


def top_tier(
    evidence: DataFrame, index: TemplateIndex, min_precision: float = MIN_PRECISION, min_recall: float = MIN_RECALL, first: DataFrame | None = None
) -> DataFrame:
    """One row per record: its qualifying tier (possibly empty) and the precisions that go with it."""
    # One narrow row per record feeds both the distinct signatures and the join back: written once.
    records = cut_lineage(record_signatures(evidence, index, first))
    tiers = settle(signature_tiers(score_signatures(records, index), min_recall))
    precision = F.coalesce(F.col("best_passed"), F.lit(0)) / F.greatest(F.col("n_fields"), F.lit(1))
    qualifies = (F.col("best_passed") > 0) & (precision >= min_precision)
    return records.join(tiers, "signature", "left").select(
        "record_id", "n_fields",
        (F.coalesce(F.col("best_seen"), F.lit(0)) / F.greatest(F.col("n_fields"), F.lit(1))).alias("best_precision"),
        F.when(qualifies, precision).alias("tier_precision"),
        F.when(qualifies, F.col("tier")).otherwise(F.array().cast("array<string>")).alias("tier"),
    )


# ---------------------------------------------------------------- ties

def _tied(tiers: DataFrame) -> DataFrame:
    return tiers.filter(F.size("tier") > 1).select("record_id", F.array_join("tier", "\x1f").alias("tier_key"), "tier")


def _clues(text: Column) -> Column:
    """What a text can say in a tie: its size as ``mm:12.0`` and its whole words as ``w:corner``."""
    size = F.concat(F.lit("mm:"), size_mm(text).cast("string"))
    words = F.transform(t.whole_words(text), lambda w: F.concat(F.lit("w:"), w))
    return F.concat(F.array_compact(F.array(size)), words)


def _leaf_clues(leaf: Column) -> Column:
    """What can decide for a template: its leaf's size, and the ASCII words that :func:`tie_clues` gives it."""
    size = F.concat(F.lit("mm:"), size_mm(leaf).cast("string"))
    return F.concat(F.array_compact(F.array(size)), F.transform(t.ascii_words(leaf), lambda w: F.concat(F.lit("w:"), w)))


def tie_clues(tied: DataFrame, index: TemplateIndex) -> DataFrame:
    """(tier_key, clue, template_id): per distinct tied set, the clues that speak for one of its members.

    A size speaks for every member whose last path part is that size.  A word speaks for a member only if it is in
    that member's last part, in no other's, and in no earlier part of any tied path.
    """
    members = (
        tied.select("tier_key", "tier").dropDuplicates(["tier_key"])
        .select("tier_key", F.explode("tier").alias("template_id"))
        .join(index.templates, "template_id")
    )
    leaf = F.element_at("category_path", -1)
    above = F.array_join(F.slice("category_path", F.lit(1), F.greatest(F.size("category_path") - 1, F.lit(0))), " ")
    word = lambda c: F.transform(t.ascii_words(c), lambda w: F.concat(F.lit("w:"), w))
    sizes = members.select(
        "tier_key", F.concat(F.lit("mm:"), size_mm(leaf).cast("string")).alias("clue"), "template_id"
    ).filter("clue IS NOT NULL")
    prefix = members.select("tier_key", F.explode(word(above)).alias("clue")).distinct()
    telling = (
        members.select("tier_key", F.explode(word(leaf)).alias("clue"), "template_id")
        .join(prefix, ["tier_key", "clue"], "left_anti")
        .groupBy("tier_key", "clue")
        .agg(F.min("template_id").alias("template_id"), F.max("template_id").alias("other"))
        .filter("template_id = other").drop("other")
    )
    return sizes.unionByName(telling)


def break_ties(tiers: DataFrame, values: DataFrame, index: TemplateIndex) -> DataFrame:
    """(record_id, by_size, by_word): what the evidence of each tied record says, null where it does not decide.

    ``by_size`` is the one member named after a stated size; ``by_word`` holds (owner, word, field) when exactly one
    telling word of the whole tie is found.  Only tied records are read, and of their texts only the words and sizes
    that end some category path leave the row.
    """
    tied = _tied(tiers)
    spoken = (
        values.filter("value IS NOT NULL")
        .join(tied.select("record_id", "tier_key"), "record_id")
        .select("record_id", "tier_key", "canon", "seq", F.explode(_clues(F.col("value"))).alias("clue"))
        .join(index.leaf_clues, "clue", "left_semi")
        .join(settle(tie_clues(tied, index)), ["tier_key", "clue"])
    )
    is_size = F.startswith("clue", F.lit("mm:"))
    size = F.when(is_size, F.col("template_id"))
    word = F.when(~is_size, F.substring("clue", 3, 1 << 30))
    return (
        spoken.groupBy("record_id")
        .agg(
            F.min(size).alias("size_lo"), F.max(size).alias("size_hi"), F.min(word).alias("word_lo"),
            F.max(word).alias("word_hi"), F.min(F.when(~is_size, F.col("template_id"))).alias("owner"),
            F.min_by("canon", F.when(~is_size, F.col("seq"))).alias("field"),
        )
        .select(
            "record_id",
            F.when(F.col("size_lo") == F.col("size_hi"), F.col("size_lo")).alias("by_size"),
            F.when(F.col("word_lo") == F.col("word_hi"), F.struct("owner", F.col("word_lo").alias("word"), "field"))
            .alias("by_word"),
        )
    )


def break_by_size(tiers: DataFrame, values: DataFrame, index: TemplateIndex) -> DataFrame:
    """(record_id, template_id) where exactly one tied category is named after a size the evidence states."""
    said = break_ties(tiers, values, index).filter("by_size IS NOT NULL")
    return said.select("record_id", F.col("by_size").alias("template_id"))


def break_by_word(tiers: DataFrame, values: DataFrame, index: TemplateIndex) -> DataFrame:
    """(record_id, template_id, word, field) where the evidence holds exactly one telling word of the tie."""
    said = break_ties(tiers, values, index).filter("by_word IS NOT NULL")
    return said.select("record_id", F.col("by_word.owner").alias("template_id"), "by_word.word", "by_word.field")


# ---------------------------------------------------------------- outcomes

def outcomes(
    evidence: DataFrame, index: TemplateIndex, min_precision: float = MIN_PRECISION, min_recall: float = MIN_RECALL
) -> DataFrame:
    """Exactly one row per record: matched, category_ambiguous or no_template_match, with confidence and reason."""
    # First values feed the signatures and the ties: names are compared and values aggregated once.
    first = cut_lineage(_first_values(evidence))
    tiers = cut_lineage(top_tier(evidence, index, min_precision, min_recall, first))
    said = break_ties(tiers, first.filter(F.col("canon").isNotNull()), index).select(
        "record_id", "by_size", F.col("by_word.owner").alias("by_word"), F.col("by_word.word").alias("tie_word"),
        F.col("by_word.field").alias("tie_field"),
    )
    joined = tiers.join(said, "record_id", "left")
    winner = F.when(F.size("tier") == 1, F.col("tier")[0]).otherwise(F.coalesce("by_size", "by_word"))
    confidence = F.coalesce("tier_precision", "best_precision")
    from_word = (F.size("tier") > 1) & F.col("by_size").isNull() & F.col("by_word").isNotNull()
    status = (
        F.when(winner.isNotNull(), "matched")
        .when(F.size("tier") > 1, "category_ambiguous")
        .otherwise("no_template_match")
    )
    tie_reason = F.format_string(
        TIE_REASON, F.size("tier"), t.python_round(confidence, 3)
    )
    return joined.select(
        "record_id",
        status.alias("status"),
        winner.alias("template_id"),
        confidence.alias("confidence"),
        F.when(status == "category_ambiguous", tie_reason)
        .when(status == "no_template_match", F.lit(NO_MATCH_REASON))
        .alias("reason"),
        F.when((F.size("tier") > 1) & F.col("by_size").isNotNull(), "size")
        .when(from_word, "content_tie_break").alias("tie_method"),
        F.when(from_word, F.col("tie_word")).alias("tie_word"),
        F.when(from_word, F.col("tie_field")).alias("tie_field"),
        F.when(status == "category_ambiguous", F.col("tier")).alias("tied"),
    )


def top_candidates(scored: Scored, decided: DataFrame, index: TemplateIndex, k: int = TOP_CANDIDATES) -> DataFrame:
    """The ``k`` best templates per record by precision; the accepted one is listed first.

    A signature's ``k`` best are found once and joined to its records as one array; the accepted template, which need
    not be among them, is looked up by (signature, template) and moved to the front.
    """
    entry = F.struct(
        (-F.col("matched")).alias("rank_by"), "template_ord", "template_id", "matched",
        _recall(F.col("n_required"), F.col("n_covered")).alias("recall"), "matched_fields", "required_present", "required_missing")
    scores = cut_lineage(scored.scores.join(index.templates.select("template_id", "template_ord"), "template_id").select("signature", "template_id", entry.alias("c")))
    # At most one entry per template; only k of them leave the group.
    best = settle(scores.groupBy("signature").agg(F.slice(F.sort_array(F.collect_list("c")), 1, k).alias("best")))
    winner = scores.select("signature", F.col("template_id").alias("winner"), F.col("c").alias("accepted"))
    wanted = scored.records.join(decided.select("record_id", F.col("template_id").alias("winner")), "record_id", "left")
    listed = wanted.join(best, "signature").join(winner, ["signature", "winner"], "left").select(
        "record_id", "n_fields", F.slice(F.concat(
            F.array_compact(F.array("accepted")),
            F.filter("best", lambda c: F.col("accepted").isNull() | (c["template_id"] != F.col("accepted.template_id")))), 1, k).alias("list"))
    return listed.select("record_id", "n_fields", F.posexplode("list").alias("at", "c")).select(
        "record_id", (F.col("at") + 1).alias("rank"), "c.template_id", t.python_round(F.col("c.matched") / F.col("n_fields"), 3).alias("score"),
        t.python_round(F.col("c.recall"), 3).alias("recall"), "c.matched_fields", "c.required_present", "c.required_missing",
    )


def tied_candidates(decided: DataFrame) -> DataFrame:
    """Every member of every unresolved tie."""
    return decided.filter("status = 'category_ambiguous'").select(
        "record_id", F.explode("tied").alias("template_id"), "confidence"
    )


def force_category(records: DataFrame, template_id: str) -> DataFrame:
    """A person's decision: every record belongs to this template, detection is skipped."""
    return records.select(
        "record_id", F.lit("matched").alias("status"), F.lit(template_id).alias("template_id"),
        F.lit(1.0).alias("confidence"),
    )
