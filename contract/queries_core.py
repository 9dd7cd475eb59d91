"""Registered queries over product evidence: values, matching, population, variants, sheets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import measures as me
from claimloom.functions import text as t
from claimloom.functions import urls
from claimloom.operators import assemble, match, populate, publish
from claimloom.session import cut_lineage, scratch_path, settle, shared_folder
from claimloom.sources import evidence as source
from claimloom.sources import workbooks
from claimloom.sources.evidence import evidence_problems

from . import catalogue as c
from . import queries_web
from . import sql as q

_MEMO: dict = {}


def _state(spark: SparkSession, sf: str) -> tuple:
    """Names, sizes and times of what lies in a folder of tables: changed data is another state."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return tuple(sorted((str(f.getPath().getName()), f.getLen(), f.getModificationTime()) for f in found))


def _once(spark: SparkSession, key: str, make, sf: str | None = None):
    """Inputs shared by many queries are written once per session and state of the tables."""
    full = (spark.sparkContext.applicationId, key, sf, _state(spark, sf) if sf else None)
    if full not in _MEMO:
        _MEMO[full] = make()
    return _MEMO[full]


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, "evidence", lambda: cut_lineage(c.evidence(spark, sf)), sf)


def index(spark: SparkSession) -> match.TemplateIndex:
    return _once(spark, "index", lambda: match.index_templates(c.templates(spark), c.fields(spark)))


def scored(spark: SparkSession, sf: str) -> match.Scored:
    return _once(spark, "scored", lambda: match.score_records(evidence(spark, sf), index(spark)), sf)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, "outcomes", lambda: cut_lineage(match.outcomes(evidence(spark, sf), index(spark))), sf)


def matched(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).filter("status = 'matched'").select("record_id", "template_id")


def population(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, "population", lambda: cut_lineage(
        populate.populate(evidence(spark, sf), matched(spark, sf), index(spark))), sf)


def _join(c_: str):
    return F.array_join(c_, "|").alias(c_)


# ---------------------------------------------------------------- values

def evidence_long(spark, sf):
    part = c.read(spark, sf, "part")
    key = F.col("p_partkey")
    wide = part.select(
        F.concat(F.lit("P"), key.cast("string")).alias("record_id"),
        F.concat(F.lit("https://example.com/p/"), key.cast("string")).alias("source_uri"),
        F.col("p_name").alias("name"), F.when(key % 4 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 3 == 0, F.lit("  ")).otherwise(F.col("p_type")).alias("finish"),
        F.col("p_retailprice").cast("decimal(12,2)").cast("string").alias("price"),
    )
    return assemble.to_evidence(wide).select("record_id", "field", "value", "source_uri", "method", "confidence")


EVIDENCE_LONG = """
WITH w AS (SELECT 'P' || p_partkey AS record_id, 'https://example.com/p/' || p_partkey AS source_uri, p_name,
  CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS b, CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END AS f,
  CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS p FROM part),
r AS (SELECT record_id, 'name' AS field, p_name AS value, source_uri FROM w UNION ALL SELECT record_id, 'brand', b, source_uri FROM w
  UNION ALL SELECT record_id, 'finish', f, source_uri FROM w UNION ALL SELECT record_id, 'price', p, source_uri FROM w)
SELECT record_id, field, value, source_uri, 'scrape' AS method, 0.9 AS confidence FROM r WHERE trim(coalesce(value, '')) <> ''"""


def evidence_violations(spark, sf):
    key = F.col("p_partkey")
    rows = c.read(spark, sf, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("record_id"), F.lit("Brand").alias("field"),
        F.when(key % 5 != 1, F.col("p_brand")).alias("value"),
        F.when(key % 7 == 0, "").when(key % 7 != 1, F.lit("https://example.com/")).alias("source_uri"),
        (key % 3 == 0).alias("absence"),
    )
    problems = evidence_problems(*[F.col(x) for x in rows.columns])
    return rows.select("record_id", F.size(problems).alias("n"), F.array_join(problems, "; ").alias("problems")).filter("n > 0")


EVIDENCE_VIOLATIONS = """
WITH r AS (SELECT 'P' || p_partkey AS id, CASE WHEN p_partkey % 5 <> 1 THEN p_brand END AS v,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 <> 1 THEN 'https://example.com/' END AS s, p_partkey % 3 = 0 AS a FROM part),
p AS (SELECT id, list_filter([
  CASE WHEN a AND v IS NOT NULL THEN id || '.Brand is stated as absent but has the value ''' || v || '''' END,
  CASE WHEN NOT a AND v IS NULL THEN id || '.Brand has neither a value nor a stated absence' END,
  CASE WHEN NOT a AND v IS NOT NULL AND coalesce(s, '') = '' THEN id || '.Brand = ''' || v || ''' has no source' END],
  lambda x: x IS NOT NULL) AS l FROM r)
SELECT id AS record_id, CAST(len(l) AS INTEGER) AS n, array_to_string(l, '; ') AS problems FROM p WHERE len(l) > 0"""


def record_id_from_url(spark, sf):
    p = c.read(spark, sf, "pages")
    return p.select("page_id", urls.record_id(F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("SKU-"), "page_id")), F.col("url")).alias("record_id"))


RECORD_ID = r"""
SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'SKU-' || page_id ELSE coalesce(nullif(regexp_extract(
  rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), '([^/]*)$', 1), ''),
  regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) END AS record_id FROM pages"""


def evidence_jsonl(spark, sf):
    """Evidence written as JSON lines, read back and checked again."""
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    source.write_evidence(evidence(spark, sf), path)
    back = source.validated(source.read_evidence(spark, path).drop("_corrupt_record"))
    return back.select("record_id", "seq", "field", F.coalesce("value", F.lit("(null)")).alias("value"), F.coalesce("source_uri", F.lit("(null)")).alias("source_uri"),
                       "method", "confidence", F.col("absence").cast("int").alias("absence"), "ts")


EVIDENCE_JSONL = f"""WITH {c.EVIDENCE_CTE} SELECT record_id, seq, field, coalesce(value, '(null)') AS value, CASE WHEN absence THEN '(null)' ELSE 'https://example.com/p/' || p_partkey END AS source_uri,
  'scrape' AS method, 0.9 AS confidence, CAST(absence AS INTEGER) AS absence, 0.0 AS ts FROM evidence"""


def evidence_order(spark, sf):
    """Evidence written as lines without numbers, read in small splits: the numbers follow the lines."""
    path = scratch_path(spark, "lines")
    rows = evidence(spark, sf).withColumn("at", F.concat(F.lpad(F.substring("record_id", 2, 20), 12, "0"), F.lpad(F.col("seq").cast("string"), 4, "0")))
    ordered = rows.repartitionByRange(4, "at").sortWithinPartitions("at")
    source.write_evidence(ordered.drop("seq", "at"), path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        back = source.read_evidence(spark, path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return back.select("record_id", "field", "seq")


EVIDENCE_ORDER = f"""WITH {c.EVIDENCE_CTE} SELECT record_id, field, row_number() OVER (ORDER BY lpad(substr(record_id, 2), 12, '0') || lpad(CAST(seq AS VARCHAR), 4, '0')) - 1 AS seq FROM evidence"""


def word_sets(spark, sf):
    d = c.read(spark, sf, "documents")
    text = F.col("text")
    return d.select(
        "doc_id", F.size(t.word_set(text)).alias("n_words"), F.array_join(F.array_sort(t.word_set(text)), " ").alias("words"),
        F.size(t.ascii_words(text)).alias("n_ascii"), F.md5(t.vocabulary_text(text)).alias("vocabulary_md5"))


WORD_SETS = f"""WITH w AS (SELECT doc_id, text, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda w: len(w) > 1 AND w NOT IN ({', '.join(f"'{w}'" for w in t.STOP_WORDS)})) AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_words, array_to_string(list_sort(l), ' ') AS words,
  CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w)))) AS INTEGER) AS n_ascii, md5({q.vtext('text')}) AS vocabulary_md5 FROM w"""


def canonical_names(spark, sf):
    e = evidence(spark, sf)
    return e.select(
        "field", t.canonical(F.col("field")).alias("canon"), t.alias_key(F.col("field")).alias("alias_key"),
        t.slug(F.col("field")).alias("slug"), t.clean_key(F.col("field")).alias("clean"),
    ).groupBy("field", "canon", "alias_key", "slug", "clean").agg(F.count("*").alias("n"))


CANONICAL = f"""
WITH {c.EVIDENCE_CTE} SELECT field, {q.canon('field')} AS canon, {q.alias_key('field')} AS alias_key,
  coalesce(nullif(trim(regexp_replace(field, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'category') AS slug,
  trim(rtrim(trim(regexp_replace(field, '\\s+', ' ', 'g')), ':')) AS clean, count(*) AS n FROM evidence GROUP BY 1, 2, 3, 4, 5"""


def unit_normalise(spark, sf):
    n = F.col("n")
    e = evidence(spark, sf).filter("value IS NOT NULL").withColumn("n", me.normalize_value(F.col("value")))
    return e.select(
        "record_id", "seq", n["kind"].alias("kind"), F.round(n["confidence"], 2).alias("confidence"),
        me.format_value(n).alias("formatted"), F.coalesce(F.get(n["nums"], F.lit(0)), F.lit(-1.0)).alias("first_mm"),
    )


UNIT_NORMALISE = f"""
WITH {c.EVIDENCE_CTE}, {q.normalized('x', 'evidence', 'record_id, seq', 'value')}
SELECT record_id, seq, kind, conf AS confidence, formatted, CASE WHEN kind = 'text' THEN -1.0 ELSE n1 END AS first_mm FROM x"""


def option_lists(spark, sf):
    e = evidence(spark, sf).select("record_id", "seq", "value", me.option_list(F.col("value")).alias("o"))
    return e.filter("o IS NOT NULL").select("record_id", "seq", "value", F.array_join("o", "|").alias("options"))


OPTION_LISTS = f"""
WITH {c.EVIDENCE_CTE} SELECT record_id, seq, value, {q.options('value')} AS options FROM evidence WHERE {q.options('value')} IS NOT NULL"""


def value_guards(spark, sf):
    v = F.col("value")
    return evidence(spark, sf).select(
        "record_id", "seq", me.single_axis_length(v).cast("int").alias("one_axis"),
        t.candidate_attribute(t.canonical(F.col("field")), v).cast("int").alias("candidate"),
        F.coalesce(me.first_number(v), F.lit(-1.0)).alias("first_number"),
        F.coalesce(me.size_mm(v), F.lit(-1.0)).alias("size_mm"),
        F.coalesce(me.from_mm(me.size_mm(v), F.lit("cm")), F.lit(-1.0)).alias("size_cm"),
        t.is_blank(v).cast("int").alias("blank"), F.array_join(t.vocabulary_tokens(v), " ").alias("tokens"),
    )


VALUE_GUARDS = f"""
WITH {c.EVIDENCE_CTE}, {q.normalized('x', 'evidence', 'record_id, seq', 'value')}
SELECT e.record_id, e.seq, CAST({q.one_axis('value')} AS INTEGER) AS one_axis, CAST({q.candidate('field', 'value')} AS INTEGER) AS candidate,
  coalesce(try_cast(replace(regexp_extract(value, '([-+]?[0-9][0-9,]*\\.?[0-9]*)', 1), ',', '') AS DOUBLE), -1.0) AS first_number,
  CASE WHEN x.kind = 'scalar' THEN x.n1 ELSE -1.0 END AS size_mm, CASE WHEN x.kind = 'scalar' THEN round(x.n1 / 10, 4) ELSE -1.0 END AS size_cm,
  CAST(trim(coalesce(value, '')) = '' AS INTEGER) AS blank, {q.vtext('value')} AS tokens
FROM evidence e LEFT JOIN x USING (record_id, seq)"""


# ---------------------------------------------------------------- matching

def evidence_map(spark, sf):
    return match.evidence_map(evidence(spark, sf)).select("record_id", "canon", F.coalesce("value", F.lit("(null)")).alias("value"), "seq")


EVIDENCE_MAP = f"WITH {c.EVIDENCE_CTE}, {q.EV_MAP_CTE} SELECT record_id, canon, coalesce(value, '(null)') AS value, seq FROM ev_map"


def field_overlap_score(spark, sf):
    return match.score_templates(evidence(spark, sf), index(spark), scored(spark, sf)).select(
        "record_id", "template_id", "n_fields", "matched", F.round("precision", 3).alias("precision"), "n_required", "n_covered",
        F.round("recall", 3).alias("recall"), _join("matched_fields"), _join("required_present"), _join("required_missing"),
    )


FIELD_OVERLAP = f"""{q.MATCH} SELECT record_id, template_id, n_fields, matched, round(precision, 3) AS precision, n_required, n_covered,
  CASE WHEN n_required > 0 THEN round(n_covered / n_required, 3) ELSE 0.0 END AS recall, matched_fields, required_present, required_missing FROM passed"""


def recall_gate(spark, sf):
    return match.gate_counts(scored(spark, sf))


RECALL_GATE = f"{q.MATCH} SELECT template_id, count(*) FILTER (gate) AS passed, count(*) FILTER (NOT gate) AS failed FROM passed GROUP BY 1"


def top_tier(spark, sf):
    return match.top_tier(evidence(spark, sf), index(spark)).select(
        "record_id", F.round("best_precision", 3).alias("best_precision"),
        F.round(F.coalesce("tier_precision", F.lit(-1.0)), 3).alias("tier_precision"), _join("tier"))


TOP_TIER = f"""{q.MATCH} SELECT r.record_id, round(coalesce(b.best, 0), 3) AS best_precision, round(coalesce(n.precision, -1.0), 3) AS tier_precision,
  coalesce(n.members, '') AS tier FROM (SELECT DISTINCT record_id FROM evidence) r LEFT JOIN tier_n n USING (record_id)
  LEFT JOIN (SELECT record_id, max(precision) AS best FROM passed GROUP BY 1) b USING (record_id)"""


def match_outcome(spark, sf):
    o = match.outcomes(evidence(spark, sf), index(spark))
    text = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return o.select("record_id", "status", text("template_id"), F.round("confidence", 3).alias("confidence"), text("reason"),
                    text("tie_method"), text("tie_word"), text("tie_field"))


MATCH_OUTCOME = f"""{q.OUTCOME} SELECT record_id, status, coalesce(template_id, '') AS template_id, round(confidence, 3) AS confidence,
  CASE status WHEN 'category_ambiguous' THEN format('unresolved tie among {{}} candidates at precision {{:.3f}}', n_tied, confidence)
   WHEN 'no_template_match' THEN 'no schema cleared the match/recall thresholds' ELSE '' END AS reason,
  coalesce(tie_method, '') AS tie_method, coalesce(tie_word, '') AS tie_word, coalesce(tie_field, '') AS tie_field FROM outcome"""


def top8_candidates(spark, sf):
    return match.top_candidates(scored(spark, sf), outcomes(spark, sf), index(spark)).select(
        "record_id", "rank", "template_id", "score", "recall", _join("matched_fields"), _join("required_present"), _join("required_missing"))


TOP8 = f"""{q.OUTCOME} SELECT p.record_id, CAST(row_number() OVER (PARTITION BY p.record_id ORDER BY coalesce(o.template_id = p.template_id, false) DESC, matched DESC, t.template_ord) AS INTEGER) AS rank,
  p.template_id, round(precision, 3) AS score, CASE WHEN n_required > 0 THEN round(n_covered / n_required, 3) ELSE 0.0 END AS recall, matched_fields, required_present, required_missing
  FROM passed p JOIN templates t USING (template_id) JOIN outcome o USING (record_id)
  QUALIFY row_number() OVER (PARTITION BY p.record_id ORDER BY coalesce(o.template_id = p.template_id, false) DESC, matched DESC, t.template_ord) <= 8"""


def tied_candidates(spark, sf):
    return match.tied_candidates(outcomes(spark, sf)).select("record_id", "template_id", F.round("confidence", 3).alias("confidence"))


TIED = f"""{q.OUTCOME} SELECT t.record_id, t.template_id, round(o.confidence, 3) AS confidence FROM tier t JOIN outcome o USING (record_id)
  WHERE o.status = 'category_ambiguous'"""


def alias_resolution(spark, sf):
    # The noun of a part is its group: nouns offer different target fields.
    part = c.read(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"), F.expr(c.NOUN).alias("group_id"))
    names = evidence(spark, sf).join(part, "record_id").select("record_id", "seq", "group_id", F.col("field").alias("name"), "value")
    targets = spark.sql("SELECT * FROM VALUES ('bolt','Size'),('bolt','Brand'),('ring','Diameter'),('ring','Size'),('rod','Diameter'),"
                        "('rod','Length'),('plate','Diameter'),('plate','Color'),('gizmo','Size'),('widget','Color') AS t(group_id, field)")
    return match.resolve_alias(names, targets).select("record_id", "seq", "name", "target")


ALIAS_RESOLUTION = f"""
WITH {c.EVIDENCE_CTE}, {q.ALIAS_CTE}, g AS (SELECT 'P' || p_partkey AS record_id, split_part(p_name, ' ', 2) AS group_id FROM part),
targets AS (SELECT * FROM (VALUES ('bolt','Size'),('bolt','Brand'),('ring','Diameter'),('ring','Size'),('rod','Diameter'),('rod','Length'),
 ('plate','Diameter'),('plate','Color'),('gizmo','Size'),('widget','Color')) AS t(group_id, field)),
r AS (SELECT e.record_id, e.seq, a.target FROM evidence e JOIN g USING (record_id)
  JOIN aliases a ON a.key = {q.alias_key('e.field')} AND (NOT a.needs_length OR {q.one_axis('e.value')})
  JOIN targets t ON t.group_id = g.group_id AND t.field = a.target QUALIFY row_number() OVER (PARTITION BY e.record_id, e.seq ORDER BY a.alias_ord) = 1)
SELECT e.record_id, e.seq, e.field AS name, coalesce(r.target, e.field) AS target FROM evidence e LEFT JOIN r USING (record_id, seq)"""


def _tiers(spark, sf):
    return _once(spark, "tiers", lambda: cut_lineage(match.top_tier(evidence(spark, sf), index(spark))), sf)


def numeric_tie_break(spark, sf):
    return match.break_by_size(_tiers(spark, sf), match.evidence_map(evidence(spark, sf)), index(spark))


def content_tie_break(spark, sf):
    return match.break_by_word(_tiers(spark, sf), match.evidence_map(evidence(spark, sf)), index(spark))


NUMERIC_TIE = f"{q.OUTCOME} SELECT record_id, template_id FROM by_size"
CONTENT_TIE = f"{q.OUTCOME} SELECT record_id, template_id, word, field FROM by_word"


def forced_category(spark, sf):
    return match.force_category(evidence(spark, sf).select("record_id").distinct(), "t04")


FORCED = f"WITH {c.EVIDENCE_CTE} SELECT DISTINCT record_id, 'matched' AS status, 't04' AS template_id, 1.0 AS confidence FROM evidence"

# ---------------------------------------------------------------- population


def _vocabularies(spark):
    """Fields of one name that offer the same terms as one row; how many templates share a list bounds ``owners``."""
    f = index(spark).fields.filter("type = 'dropdown'").withColumn("canon", t.canonical(F.col("name")))
    return _once(spark, "vocabularies", lambda: settle(
        f.groupBy("canon", "vocabulary", "vocabulary_lower", "vocabulary_padded").agg(F.collect_list(F.struct("template_id", "name")).alias("owners"))))


def _vocab_rows(spark, sf, found):
    """(record_id, seq, template_id, name, found): a value is looked up once in every list, whatever number of templates share it."""
    looked_up = evidence(spark, sf).filter("value IS NOT NULL").select(
        "record_id", "seq", "value", t.canonical(F.col("field")).alias("canon")
    ).join(_vocabularies(spark), "canon").select("record_id", "seq", "owners", found.alias("found"))
    return looked_up.select("record_id", "seq", F.explode("owners").alias("o"), "found").select("record_id", "seq", "o.template_id", "o.name", "found")


def dropdown_ladder(spark, sf):
    m = populate.match_vocabulary(*map(F.col, ("value", "vocabulary", "vocabulary_lower", "vocabulary_padded")))
    return _vocab_rows(spark, sf, m).select(
        "record_id", "seq", "template_id", "name", F.coalesce("found.term", F.lit("")).alias("term"), "found.method", "found.confidence")


DROPDOWN = f"""WITH {c.EVIDENCE_CTE}, {c.TEMPLATE_CTE},
s AS (SELECT e.record_id, e.seq, f.template_id, f.name, e.value AS raw, string_split(f.vocab, '|') AS voc FROM evidence e
  JOIN fields f ON f.type = 'dropdown' AND {q.canon('f.name')} = {q.canon('e.field')} WHERE e.value IS NOT NULL),
l AS (SELECT record_id, seq, template_id, name, {q.LADDER_COLUMNS} FROM s), l2 AS (SELECT *, {q.LADDER_METHOD} AS method FROM l)
SELECT record_id, seq, template_id, name, coalesce({q.LADDER_TERM}, '') AS term, method, CASE method WHEN 'exact' THEN 1.0 WHEN 'case_insensitive' THEN 0.95
  WHEN 'normalized' THEN 0.85 WHEN 'whole_word_containment' THEN 0.7 ELSE 0.0 END AS confidence FROM l2"""


def whole_word_terms(spark, sf):
    words = populate.whole_word_terms(F.col("value"), F.col("vocabulary"), F.col("vocabulary_padded"))
    return _vocab_rows(spark, sf, words).select("record_id", "seq", "template_id", "name", F.array_join("found", "|").alias("terms"))


WHOLE_WORD = DROPDOWN.split("l2 AS")[0].rstrip().rstrip(",") + " SELECT record_id, seq, template_id, name, array_to_string(words, '|') AS terms FROM l"


def populate_fields(spark, sf):
    p = populate.populate(evidence(spark, sf), matched(spark, sf), index(spark))
    return p.select("record_id", "template_id", "name", F.col("required").cast("int").alias("required"), "status",
                    F.coalesce("value", F.lit("")).alias("value"), F.coalesce("reason", F.lit("")).alias("reason"), _join("candidates"))


POPULATE = f"""{q.POPULATION} SELECT record_id, template_id, name, CAST(required AS INTEGER) AS required, status, coalesce(value, '') AS value,
  coalesce(reason, '') AS reason, candidates FROM population"""


def field_values(spark, sf):
    return populate.field_values(evidence(spark, sf), matched(spark, sf), index(spark)).select("record_id", "template_id", "field_canon", "value")


FIELD_VALUES = f"{q.POPULATION} SELECT record_id, template_id, field_canon, value FROM vals"


def record_readiness(spark, sf):
    return populate.readiness(population(spark, sf)).select(
        "record_id", "template_id", "status", "populated_count", "needs_input_count", _join("missing_required"))


_READY = """CASE WHEN count(*) FILTER (required AND (status <> 'populated' OR value IS NULL)) = 0 THEN 'ready_for_review' ELSE 'incomplete' END AS status,
  count(*) FILTER (status = 'populated') AS populated_count, count(*) FILTER (status <> 'populated') AS needs_input_count,
  coalesce(string_agg(name, '|' ORDER BY field_ord) FILTER (required AND (status <> 'populated' OR value IS NULL)), '') AS missing_required"""
READINESS = f"{q.POPULATION} SELECT record_id, template_id, {_READY} FROM population GROUP BY 1, 2"


def variant_axis(spark, sf):
    return populate.variant_axis(population(spark, sf)).select("record_id", "expanded_field", "option_count", _join("other_variant_fields"))


VARIANT_AXIS = f"""{q.VARIANTS} SELECT a.record_id, a.name AS expanded_field, CAST(a.n AS INTEGER) AS option_count,
  coalesce((SELECT string_agg(o.name, '|' ORDER BY o.field_ord) FROM opt o WHERE o.record_id = a.record_id AND o.n > 0 AND o.name <> a.name), '') AS other_variant_fields FROM axis a"""


def variant_rows(spark, sf):
    return populate.expand_variants(population(spark, sf)).select(
        "record_id", "variant_no", "name", "status", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("reason", F.lit("")).alias("reason"))


VARIANT_ROWS = f"""{q.VARIANTS} SELECT record_id, CAST(variant_no AS INTEGER) AS variant_no, name, status, coalesce(value, '') AS value,
  coalesce(reason, '') AS reason FROM variants"""


def variant_readiness(spark, sf):
    return populate.readiness(populate.expand_variants(population(spark, sf)), "record_id", "variant_no").select(
        "record_id", "variant_no", "status", "populated_count", "needs_input_count", _join("missing_required"))


VARIANT_READY = f"{q.VARIANTS} SELECT record_id, CAST(variant_no AS INTEGER) AS variant_no, {_READY} FROM variants GROUP BY 1, 2"

# ---------------------------------------------------------------- sheets


def variants(spark, sf):
    return _once(spark, "variants", lambda: cut_lineage(populate.expand_variants(population(spark, sf))), sf)


def cells(spark, sf):
    return _once(spark, "cells", lambda: cut_lineage(publish.cell_values(variants(spark, sf), c.fields(spark))), sf)


def parts(spark, sf):
    rows = lambda: variants(spark, sf).select("template_id", "record_id", "variant_no").distinct()
    return _once(spark, "parts", lambda: cut_lineage(publish.sheet_parts(rows(), c.templates(spark))), sf)


def cell_buckets(spark, sf):
    out = publish.cell_values(variants(spark, sf), c.fields(spark))
    numeric = (F.col("type") == "numeric") & F.col("cell").isNotNull()
    return out.select(
        "record_id", "variant_no", "name", "bucket", F.when(numeric, "").otherwise(F.coalesce("cell", F.lit(""))).alias("text_cell"),
        F.when(numeric, F.round(F.col("cell").cast("double"), 4)).otherwise(-1.0).alias("number_cell"))


_CELLS_CTE = f"""
units AS (SELECT f.template_id, f.name, CASE WHEN count(u.vocab) > 0 AND NOT contains(min(u.vocab), '|') AND min(u.vocab) <> '' THEN min(u.vocab) END AS unit
  FROM fields f LEFT JOIN fields u ON u.template_id = f.template_id AND u.name = f.name || ' Unit' GROUP BY 1, 2),
form AS (SELECT f.*, u.unit, {q.canon('f.name')} = 'floor price' AS reserved FROM fields f JOIN units u USING (template_id, name) WHERE NOT locked AND NOT is_formula),
rows_ AS (SELECT record_id, variant_no, template_id, name, status, value FROM variants UNION ALL
  SELECT DISTINCT v.record_id, v.variant_no, v.template_id, f.name, 'needs_input', NULL FROM variants v JOIN form f ON f.template_id = v.template_id AND f.reserved),
{q.normalized('cnorm', 'rows_', 'record_id, variant_no, name', 'value')},
placed AS (SELECT r.*, f.type, f.vocab, f.reserved, CASE WHEN n.kind = 'scalar' THEN CASE WHEN f.unit IS NULL THEN n.n1 ELSE round(n.n1 / {q.mm('f.unit')}, 4) END END AS num
  FROM rows_ r JOIN form f USING (template_id, name) LEFT JOIN cnorm n USING (record_id, variant_no, name)),
cells AS (SELECT *, CASE WHEN reserved THEN 'never_populate' WHEN (status <> 'populated' OR value IS NULL) AND status = 'variant_candidate' THEN 'variant_candidate'
  WHEN status <> 'populated' OR value IS NULL THEN 'needs_input' WHEN type = 'numeric' AND num IS NULL THEN 'unresolved_numeric'
  WHEN type = 'dropdown' AND vocab <> '' AND NOT list_contains(string_split(vocab, '|'), value) THEN 'invalid_dropdown' ELSE 'written' END AS bucket FROM placed)"""
_CELLS = f"{q.VARIANTS}, {_CELLS_CTE}"
CELL_BUCKETS = f"""{_CELLS} SELECT record_id, CAST(variant_no AS INTEGER) AS variant_no, name, bucket,
  CASE WHEN bucket <> 'written' OR type = 'numeric' THEN '' ELSE value END AS text_cell,
  CASE WHEN bucket = 'written' AND type = 'numeric' THEN round(num, 4) ELSE -1.0 END AS number_cell FROM cells"""


def fill_stats(spark, sf):
    return publish.fill_stats(cells(spark, sf)).withColumn("fill_rate", F.round("fill_rate", 3))


FILL_STATS = f"""{_CELLS} SELECT template_id, name, {', '.join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in publish.BUCKETS)},
  round(count(*) FILTER (bucket = 'written') / count(*), 3) AS fill_rate FROM cells GROUP BY 1, 2"""


def sheet_parts(spark, sf):
    return parts(spark, sf).select("template_id", "part", "sheet", "record_id", "variant_no", "row_no")


_PARTS_CTE = """
vr AS (SELECT DISTINCT template_id, record_id, variant_no FROM variants),
numbered AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY record_id, variant_no) AS row_no, count(*) OVER (PARTITION BY template_id) AS n FROM vr),
parts AS (SELECT d.*, t.path, CAST(floor((row_no - 1) / coalesce(row_limit, 500)) AS BIGINT) + 1 AS part,
  'products__' || trim(regexp_replace(replace(path, ' > ', '_'), '[^A-Za-z0-9]+', '_', 'g'), '_') ||
  CASE WHEN n > coalesce(row_limit, 500) THEN '_part' || CAST(CAST(floor((row_no - 1) / coalesce(row_limit, 500)) AS BIGINT) + 1 AS VARCHAR) ELSE '' END AS sheet
  FROM numbered d JOIN templates t USING (template_id))"""
SHEET_PARTS = f"""{q.VARIANTS}, {_PARTS_CTE} SELECT template_id, part, sheet, record_id, CAST(variant_no AS INTEGER) AS variant_no, row_no FROM parts"""


def order_sheets(spark, sf):
    """Row-limited parts over orders by priority: a category of any size is cut into exact, ordered parts."""
    rows = c.read(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("template_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("record_id"), F.lit(0).alias("variant_no"))
    t_ = spark.sql("SELECT * FROM VALUES ('1-URGENT', 1000), ('2-HIGH', 700), ('3-MEDIUM', 500), ('4-NOT SPECIFIED', 250), ('5-LOW', 100000000) AS t(template_id, row_limit)")
    t_ = t_.withColumn("category_path", F.array(F.lit("Orders"), F.col("template_id")))
    return publish.sheet_parts(rows, t_, "orders").select("template_id", "part", "sheet", "record_id", "row_no")


ORDER_SHEETS = """
WITH l AS (SELECT * FROM (VALUES ('1-URGENT', 1000), ('2-HIGH', 700), ('3-MEDIUM', 500), ('4-NOT SPECIFIED', 250), ('5-LOW', 100000000)) AS t(template_id, row_limit)),
n AS (SELECT o_orderpriority AS template_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS record_id,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS row_no, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT template_id, CAST(floor((row_no - 1) / row_limit) AS BIGINT) + 1 AS part, 'orders__Orders_' || trim(regexp_replace(template_id, '[^A-Za-z0-9]+', '_', 'g'), '_') ||
  CASE WHEN n > row_limit THEN '_part' || CAST(CAST(floor((row_no - 1) / row_limit) AS BIGINT) + 1 AS VARCHAR) ELSE '' END AS sheet, record_id, row_no FROM n JOIN l USING (template_id)"""


def _damaged(cells, rules, files):
    """Workbooks as someone else's program might have changed them: labels, columns, formats, words and values."""
    number = F.regexp_extract("template_id", r"_part(\d+)$", 1).try_cast("int")
    part, head = F.coalesce(number, F.lit(1)), (F.col("sheet") == "Template") & (F.col("row") == workbooks.HEADER_ROW)
    text = (F.when(head & (F.col("col") == 2) & (part % 2 == 0), F.rtrim("text", F.lit("*")))
            .when((F.col("sheet") == "Lookup") & (F.col("text") == "Gold") & (part % 4 == 1), F.lit("Copper"))
            .when((F.col("sheet") == "Template") & (F.col("row") == workbooks.SECTION_ROW) & (F.col("text") == "Attributes") & (part % 7 == 2), F.lit("Features"))
            .when((F.col("sheet") == "Template") & (F.col("row") == workbooks.DATA_ROW + 1) & (F.col("col") == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    plain = (F.col("sheet") == "Template") & (F.col("row") == workbooks.DATA_ROW) & (F.col("col") == 3) & (part % 5 == 1)
    gone = (F.col("sheet") == "Template") & (F.col("col") == 5) & (part % 3 == 0)
    return cells.filter(~gone).withColumn("number_format", F.when(plain, "General").otherwise(F.col("number_format"))).withColumn("text", text), rules, files


def sheet_round_trip(spark, sf):
    """Sheets written as workbooks, changed by someone, read by the template parser and compared."""
    p = parts(spark, sf)
    written = cut_lineage(publish.sheet_cells(cells(spark, sf), p))
    books = workbooks.sheet_workbooks(written, p, c.templates(spark), c.fields(spark))
    path = scratch_path(spark, "books")
    workbooks.write_workbooks(*_damaged(*books), p, path)
    found = workbooks.check_workbooks(written, c.fields(spark), p, workbooks.stored_workbooks(spark, path, books))
    return found.select("template_id", "sheet", "part", "name", "problem")


# A column that is gone takes the values of its rows along; measured ones are compared as written, by any text.
SHEET_ROUND_TRIP = f"""{_CELLS}, {_PARTS_CTE.strip()},
books AS (SELECT DISTINCT template_id, sheet, part FROM parts),
columns_ AS (SELECT f.*, ascii(f.col) - 64 AS n, coalesce(lag(section) OVER (PARTITION BY template_id ORDER BY field_ord) <> section, true) AS starts FROM fields f),
judged AS (SELECT b.template_id, b.sheet, b.part, c.name, c.n, CASE WHEN c.n = 5 AND b.part % 3 = 0 THEN 'missing' ELSE array_to_string(list_filter([
  CASE WHEN c.type = 'numeric' AND c.n = 3 AND b.part % 5 = 1 THEN 'type' END,
  CASE WHEN c.required AND c.n = 2 AND b.part % 2 = 0 THEN 'required' END,
  CASE WHEN c.section = 'Attributes' AND b.part % 7 = 2 THEN 'section' END,
  CASE WHEN c.type = 'dropdown' AND list_contains(string_split(c.vocab, '|'), 'Gold') AND b.part % 4 = 1 THEN 'vocabulary' END], lambda x: x IS NOT NULL), ',') END AS problem
  FROM books b JOIN columns_ c USING (template_id)),
stored AS (SELECT p.template_id, p.sheet, p.part, x.name, c.n, p.row_no - (p.part - 1) * coalesce(t.row_limit, 500) + 2 AS r FROM cells x JOIN parts p USING (record_id, variant_no, template_id)
  JOIN columns_ c USING (template_id, name) JOIN templates t USING (template_id) WHERE bucket = 'written' AND (x.type = 'numeric' OR x.value <> ''))
SELECT template_id, sheet, part, name, problem FROM judged WHERE problem <> ''
UNION ALL SELECT template_id, sheet, part, name, 'row ' || r || ' missing' FROM stored WHERE (n = 5 AND part % 3 = 0) OR (n = 1 AND r = 4)
UNION ALL SELECT template_id, sheet, part, name, 'row ' || r || ' unexpected' FROM stored WHERE n = 1 AND r = 4"""


def run_report(spark, sf):
    """The whole report: captures of the given pages, and what became of the evidence of the parts."""
    given = queries_web._pages(spark, sf).select(F.col("page_id").alias("ord"), F.contains("html", F.lit("<img")).alias("image"))
    captured = queries_web.capture_plan(spark, sf).join(given, "ord")
    return publish.run_report(
        captured, outcomes(spark, sf), parts(spark, sf), variants=variant_axis(spark, sf), failures=write_failures_all(spark, sf), fill=fill_stats(spark, sf),
        media=media_reconcile(spark, sf))


_MEASURED = sorted({name for *_, fields in c.TEMPLATES for name, kind, *_ in fields if kind == "numeric"})


def _readback(spark, sf):
    """All written cells against a copy in which some were changed and some are gone."""
    out = cells(spark, sf).filter("bucket = 'written'").select("record_id", "variant_no", "name", "cell")
    key = F.substring("record_id", 2, 20).cast("bigint")
    broken = out.filter(key % 17 != 0).withColumn("cell", F.when(key % 23 == 0, F.concat("cell", F.lit("!"))).otherwise(F.col("cell")))
    return publish.verify_sheet(out, broken)


def readback_diff(spark, sf):
    """The differing cells of all columns but the measured ones, which :func:`readback_diff_measured` has."""
    return _readback(spark, sf).filter(~F.col("name").isin(_MEASURED)).select("record_id", "variant_no", "name", "cell", "side", "copies")


READBACK = f"""{_CELLS}, o AS (SELECT record_id, variant_no, name, value AS cell, CAST(substr(record_id, 2) AS BIGINT) AS k FROM cells WHERE bucket = 'written' AND name NOT IN ({', '.join(f"'{n}'" for n in _MEASURED)})),
b AS (SELECT record_id, variant_no, name, CASE WHEN k % 23 = 0 THEN cell || '!' ELSE cell END AS cell FROM o WHERE k % 17 <> 0),
d AS (SELECT *, 'missing' AS side FROM (SELECT record_id, variant_no, name, cell FROM o EXCEPT ALL SELECT * FROM b) UNION ALL
      SELECT *, 'unexpected' FROM (SELECT * FROM b EXCEPT ALL SELECT record_id, variant_no, name, cell FROM o))
SELECT record_id, CAST(variant_no AS INTEGER) AS variant_no, name, cell, side, CAST(count(*) AS BIGINT) AS copies FROM d GROUP BY ALL"""


def readback_diff_measured(spark, sf):
    """The differing cells of measured columns: written in the column's unit, compared as numbers."""
    d = _readback(spark, sf).filter(F.col("name").isin(_MEASURED))
    return d.select("record_id", "variant_no", "name", F.round(F.regexp_replace("cell", "!$", "").cast("double"), 4).alias("number"),
                    F.col("cell").endswith("!").cast("int").alias("changed"), "side", "copies")


READBACK_MEASURED = f"""{_CELLS}, o AS (SELECT record_id, variant_no, name, round(num, 4) AS number, 0 AS changed, CAST(substr(record_id, 2) AS BIGINT) AS k FROM cells WHERE bucket = 'written' AND name IN ({', '.join(f"'{n}'" for n in _MEASURED)})),
b AS (SELECT record_id, variant_no, name, number, CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS changed FROM o WHERE k % 17 <> 0),
d AS (SELECT *, 'missing' AS side FROM (SELECT record_id, variant_no, name, number, changed FROM o EXCEPT ALL SELECT * FROM b) UNION ALL
      SELECT *, 'unexpected' FROM (SELECT * FROM b EXCEPT ALL SELECT record_id, variant_no, name, number, changed FROM o))
SELECT record_id, CAST(variant_no AS INTEGER) AS variant_no, name, number, CAST(changed AS INTEGER) AS changed, side, CAST(count(*) AS BIGINT) AS copies FROM d GROUP BY ALL"""


def _failures(spark, sf, diff):
    p = parts(spark, sf).select("record_id", "variant_no", "category_slug", "part")
    return publish.write_failures(diff.join(p, ["record_id", "variant_no"]))


def write_failures_all(spark, sf):
    """Mismatches of every column, measured ones too."""
    return _failures(spark, sf, _readback(spark, sf))


def write_failures(spark, sf):
    """Mismatches of the columns of :func:`readback_diff`."""
    return _failures(spark, sf, readback_diff(spark, sf))


WRITE_FAILURES = READBACK.replace("SELECT record_id, CAST(variant_no AS INTEGER) AS variant_no, name, cell, side, CAST(count(*) AS BIGINT) AS copies FROM d GROUP BY ALL", "").rstrip() + f""",
{_PARTS_CTE.strip()}
SELECT trim(regexp_replace(replace(p.path, ' > ', '_'), '[^A-Za-z0-9]+', '_', 'g'), '_') AS category_slug, p.part, count(*) AS mismatches,
  'read-back differs from what was written' AS error FROM d JOIN parts p USING (record_id, variant_no) GROUP BY 1, 2"""


WRITE_FAILURES_ALL = WRITE_FAILURES.replace(f""" AND name NOT IN ({', '.join(f"'{n}'" for n in _MEASURED)})""", "")


def _fields() -> list[str]:
    """Every field name that the evidence of the given tables can hold."""
    return sorted(set(re.findall(r"THEN '([^']+)'", c.FIELD)) | set(re.findall(r"ELSE '([^']+)'", c.FIELD)))


def sku_wide(spark, sf):
    names = _fields()
    wide = publish.sku_wide(evidence(spark, sf), names)
    return wide.select("record_id", *[F.coalesce(F.col(f"`{x}`"), F.lit("")).alias(x) for x in names])


SKU_WIDE = f"""WITH {c.EVIDENCE_CTE}, f AS (SELECT record_id, field, value FROM evidence WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY seq) = 1)
SELECT r.record_id, {', '.join(f'''coalesce(max(CASE WHEN field = '{x}' THEN value END), '') AS "{x}"''' for x in _fields())}
  FROM (SELECT DISTINCT record_id FROM evidence) r LEFT JOIN f USING (record_id) GROUP BY r.record_id"""


def sku_images(spark, sf):
    return publish.sku_images(c.read(spark, sf, "part").filter("p_partkey % 3 <> 0").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("record_id"),
        F.explode(F.array(F.concat(F.lit("P"), "p_partkey", F.lit("_1.webp")), F.concat(F.lit("P"), "p_partkey", F.lit("_0.webp")))).alias("name")))


SKU_IMAGES = """SELECT 'P' || p_partkey AS record_id, (n + 1)::BIGINT AS image_no, 'P' || p_partkey || '_' || n || '.webp' AS name
FROM part, (SELECT unnest(range(0, 2)) AS n) WHERE p_partkey % 3 <> 0"""


def media_reconcile(spark, sf):
    key = F.col("p_partkey")
    name = lambda n: F.concat(F.lit("P"), key.cast("string"), F.lit(f"_{n}.webp"))
    part = c.read(spark, sf, "part").withColumn("pack", F.col("p_brand"))
    cells_ = part.select(
        "pack", F.lit("t01").alias("template_id"), key.cast("string").alias("record_id"), F.lit("Cover Image").alias("name"),
        F.when(key % 5 == 0, F.concat(F.lit("https://example.com/a.jpg, "), name(0))).otherwise(F.concat_ws(",", name(0), name(1))).alias("cell"))
    form = spark.sql("SELECT * FROM VALUES ('t01', 'Cover Image', 'Media'), ('t01', 'Name', 'Meta') AS t(template_id, name, section)")
    named = publish.referenced_media(cells_, form).join(part.select("pack", key.cast("string").alias("record_id")), "record_id").select("pack", "file")
    given = part.filter(key % 7 != 0).select("pack", name(0).alias("file")).union(part.filter(key % 4 == 0).select("pack", name(1)))
    return publish.reconcile_media(named, given, "pack")


MEDIA_RECONCILE = """
WITH n AS (SELECT p_brand AS pack, 'P' || p_partkey || '_0.webp' AS file FROM part UNION SELECT p_brand, 'P' || p_partkey || '_1.webp' FROM part WHERE p_partkey % 5 <> 0),
g AS (SELECT p_brand AS pack, 'P' || p_partkey || '_0.webp' AS file FROM part WHERE p_partkey % 7 <> 0 UNION SELECT p_brand, 'P' || p_partkey || '_1.webp' FROM part WHERE p_partkey % 4 = 0)
SELECT pack, file, 'missing' AS problem FROM n WHERE (pack, file) NOT IN (SELECT (pack, file) FROM g)
UNION ALL SELECT pack, file, 'unreferenced' FROM g WHERE (pack, file) NOT IN (SELECT (pack, file) FROM n)"""


def media_by_record(spark, sf):
    """Media of each supplier's parts, in chunks of 10 references."""
    li = c.read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    numbered = li.withColumn("seq", F.col("l_partkey"))
    refs = numbered.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("record_id"), "seq",
        F.concat(F.lit("https://example.com/"), F.col("l_partkey").cast("string"), F.lit(".mp4")).alias("url"),
        F.when(F.col("l_partkey") % 2 == 0, "video").otherwise("gif").alias("media_type"))
    out = publish.media_refs_by_record(refs, 100)
    return out.select("record_id", "chunk_no", F.size("refs").alias("n"),
                      F.array_join(F.transform("refs", lambda r: F.concat(r["media_type"], F.lit(":"), r["url"])), " ").alias("refs"))


MEDIA_BY_RECORD = """
SELECT 'S' || l_suppkey AS record_id, CAST(floor(l_partkey / 100) AS BIGINT) AS chunk_no, CAST(count(*) AS INTEGER) AS n,
  string_agg(CASE WHEN l_partkey % 2 = 0 THEN 'video' ELSE 'gif' END || ':https://example.com/' || l_partkey || '.mp4', ' ' ORDER BY l_partkey) AS refs
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1, 2"""


RUN_REPORT = f"""WITH cap AS ({queries_web.CAPTURE_PLAN})
SELECT * FROM ({q.VARIANTS}, {_PARTS_CTE.strip()} SELECT 'outcome' AS section, status AS label, count(*) AS n FROM outcome GROUP BY 2 UNION ALL SELECT 'sheet', sheet, count(*) FROM parts GROUP BY 2)
UNION ALL SELECT 'capture', status, count(*) FROM cap GROUP BY 2
UNION ALL SELECT 'image', CASE WHEN contains(p.html, '<img') THEN 'with image' ELSE 'without image' END, count(*) FROM cap JOIN pages p ON p.page_id = cap.ord WHERE status = 'captured' GROUP BY 2
UNION ALL SELECT 'variant', expanded_field, count(*) FROM ({VARIANT_AXIS}) GROUP BY 2
UNION ALL SELECT 'write_failure', category_slug || ' part ' || part, sum(mismatches)::BIGINT FROM ({WRITE_FAILURES_ALL}) GROUP BY 2
UNION ALL SELECT 'written', template_id || '.' || name, sum(written)::BIGINT FROM ({FILL_STATS}) GROUP BY 2
UNION ALL SELECT 'media', problem, count(*) FROM ({MEDIA_RECONCILE}) GROUP BY 2"""

QUERIES = {
    "evidence_jsonl": (evidence_jsonl, EVIDENCE_JSONL), "word_sets": (word_sets, WORD_SETS),
    "evidence_long": (evidence_long, EVIDENCE_LONG), "evidence_violations": (evidence_violations, EVIDENCE_VIOLATIONS),
    "record_id_from_url": (record_id_from_url, RECORD_ID), "canonical_names": (canonical_names, CANONICAL),
    "unit_normalise": (unit_normalise, UNIT_NORMALISE), "option_lists": (option_lists, OPTION_LISTS),
    "value_guards": (value_guards, VALUE_GUARDS), "evidence_map": (evidence_map, EVIDENCE_MAP),
    "field_overlap_score": (field_overlap_score, FIELD_OVERLAP), "recall_gate": (recall_gate, RECALL_GATE),
    "top_tier": (top_tier, TOP_TIER), "match_outcome": (match_outcome, MATCH_OUTCOME),
    "top8_candidates": (top8_candidates, TOP8), "tied_candidates": (tied_candidates, TIED),
    "alias_resolution": (alias_resolution, ALIAS_RESOLUTION), "numeric_tie_break": (numeric_tie_break, NUMERIC_TIE),
    "content_tie_break": (content_tie_break, CONTENT_TIE), "forced_category": (forced_category, FORCED),
    "dropdown_ladder": (dropdown_ladder, DROPDOWN), "whole_word_terms": (whole_word_terms, WHOLE_WORD),
    "field_values": (field_values, FIELD_VALUES), "populate_fields": (populate_fields, POPULATE),
    "record_readiness": (record_readiness, READINESS), "variant_axis": (variant_axis, VARIANT_AXIS),
    "variant_rows": (variant_rows, VARIANT_ROWS), "variant_readiness": (variant_readiness, VARIANT_READY),
    "cell_buckets": (cell_buckets, CELL_BUCKETS), "fill_stats": (fill_stats, FILL_STATS), "sheet_parts": (sheet_parts, SHEET_PARTS),
    "order_sheets": (order_sheets, ORDER_SHEETS), "run_report": (run_report, RUN_REPORT), "evidence_order": (evidence_order, EVIDENCE_ORDER), "sheet_round_trip": (sheet_round_trip, SHEET_ROUND_TRIP), "readback_diff": (readback_diff, READBACK), "readback_diff_measured": (readback_diff_measured, READBACK_MEASURED),
    "write_failures": (write_failures, WRITE_FAILURES), "write_failures_all": (write_failures_all, WRITE_FAILURES_ALL), "sku_wide": (sku_wide, SKU_WIDE), "sku_images": (sku_images, SKU_IMAGES), "media_reconcile": (media_reconcile, MEDIA_RECONCILE),
    "media_by_record": (media_by_record, MEDIA_BY_RECORD),
}
