"""Packs: header, checksums, and an audit that trusts nothing but the stored bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut_lineage
from ..sources.evidence import EVIDENCE, evidence_problems

# Parts every pack must hold, and keys its header must have.
REQUIRED_PARTS = ("datapackage.json", "evidence.jsonl", "manifest-sha256.txt")
HEADER_KEYS = ("version", "producer", "product_count")
PACK_VERSION = "1.0"
POLICY = "no-evidence-no-value"


def pack_header(evidence: DataFrame, media: DataFrame) -> DataFrame:
    """(pack, version, product_count, media_count, provenance_policy); distinct products are counted in two steps."""
    products = evidence.select("pack", "record_id").distinct().groupBy("pack").agg(F.count("*").alias("product_count"))
    files = media.select("pack", "name").distinct().groupBy("pack").agg(F.count("*").alias("media_count"))
    return products.join(files, "pack", "left").select(
        "pack", F.lit(PACK_VERSION).alias("version"), "product_count",
        F.coalesce("media_count", F.lit(0)).alias("media_count"), F.lit(POLICY).alias("provenance_policy"),
    )


def pack_resources(media: DataFrame) -> DataFrame:
    """(pack, path) of the media files listed in the header; one row each, so a pack may hold any number."""
    return media.select("pack", F.concat(F.lit("media/"), F.col("name")).alias("path")).distinct()


def manifest(parts: DataFrame) -> DataFrame:
    """(pack, path, sha256) of each stored part."""
    return parts.filter(F.col("path") != "manifest-sha256.txt").select(
        "pack", "path", F.sha2("content", 256).alias("sha256")
    )


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """(pack, path, content) of stored packs: one folder per pack, files of any kind below it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    home = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(home.replace("file:///", "file:/")) + 2, 1 << 30)
    return files.select(F.substring_index(below, "/", 1).alias("pack"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "content")


def _line_errors(content: Column) -> Column:
    """Problems of the lines of an evidence part, numbered without blank lines."""
    lines = F.filter(F.split(content.cast("string"), r"\r?\n"), lambda x: F.trim(x) != "")

    def errors(line: Column, n: Column) -> Column:
        at = F.concat(F.lit("evidence.jsonl line "), n.cast("string"), F.lit(": "))
        row = F.from_json(line, EVIDENCE)
        found = let(row, lambda r: evidence_problems(*[r[c] for c in ("record_id", "field", "value", "source_uri", "absence")]))
        return F.when(F.try_parse_json(line).isNull(), F.array(F.concat(at, F.lit("invalid JSON")))).otherwise(F.transform(found, lambda p: F.concat(at, p)))

    return F.flatten(F.transform(lines, errors))


def pack_facts(parts: DataFrame, header_keys: tuple[str, ...] = HEADER_KEYS) -> DataFrame:
    """(pack, path, sha256, header, errors): all that an audit asks of a part's bytes, in one reading and without moving them.

    ``header`` is null but for a header part: whether it is JSON, and the keys it lacks.  ``errors`` has one text per
    bad line of an evidence part; good lines leave nothing.
    """
    lacking = lambda v: F.array_compact(F.array(*[
        F.when(F.try_variant_get(v, f"$.{k}", "variant").isNull(), F.lit(f"datapackage.json missing required key: '{k}'")) for k in header_keys]))
    none = F.array().cast("array<string>")
    header = let(F.try_parse_json(F.col("content").cast("string")), lambda v: F.struct(v.isNotNull().alias("readable"), F.when(v.isNotNull(), lacking(v)).otherwise(none).alias("lacking")))
    return parts.select(
        "pack", "path", F.sha2("content", 256).alias("sha256"), F.when(F.col("path") == "datapackage.json", header).alias("header"),
        F.when(F.col("path") == "evidence.jsonl", _line_errors(F.col("content"))).otherwise(none).alias("errors"))


def audit_packs(parts: DataFrame, listed: DataFrame, header_keys: tuple[str, ...] = HEADER_KEYS) -> DataFrame:
    """Every error of every pack as (pack, error); a pack without rows here is sound.

    ``parts`` has (pack, path, content); ``listed`` is each pack's own manifest as (pack, path, sha256).  A pack
    without its required parts is reported for that alone.  Contents are read once; joins see hashes and errors only.
    """
    facts = cut_lineage(pack_facts(parts, header_keys))
    packs = facts.select("pack").unionByName(listed.select("pack")).distinct()
    wanted = packs.select("pack", F.explode(F.array(*[F.lit(p) for p in REQUIRED_PARTS])).alias("path"))
    absent = wanted.join(facts.select("pack", "path").distinct(), ["pack", "path"], "left_anti")
    incomplete = cut_lineage(absent.groupBy("pack").agg(
        F.concat(F.lit("missing required file(s): "), F.array_join(F.array_sort(F.collect_set("path")), ", ")).alias("error")
    ))
    whole = facts.join(incomplete, "pack", "left_anti")
    no_json = whole.filter("NOT header.readable").select("pack", F.lit("datapackage.json is not valid JSON").alias("error"))
    readable = cut_lineage(whole.join(no_json, "pack", "left_anti"))
    no_key = readable.select("pack", F.explode("header.lacking").alias("error"))
    checked = listed.join(readable.select("pack").distinct(), "pack", "left_semi").join(
        readable.select("pack", "path", F.col("sha256").alias("actual")), ["pack", "path"], "left")
    wrong = checked.filter("actual IS NULL OR actual <> sha256").select(
        "pack",
        F.when(F.col("actual").isNull(), F.concat(F.lit("manifest references missing file: "), "path"))
        .otherwise(F.concat(
            F.lit("checksum mismatch for "), "path", F.lit(": manifest says "), F.substring("sha256", 1, 12),
            F.lit("…, actual is "), F.substring("actual", 1, 12), F.lit("…"),
        )).alias("error"),
    )
    bad_lines = readable.select("pack", F.explode("errors").alias("error"))
    return incomplete.unionByName(no_json).unionByName(no_key).unionByName(wrong).unionByName(bad_lines)


def audit_summary(parts: DataFrame, errors: DataFrame) -> DataFrame:
    """(pack, ok, n_errors) for every pack."""
    counted = errors.groupBy("pack").agg(F.count("*").alias("n"))
    return parts.select("pack").distinct().join(counted, "pack", "left").select(
        "pack", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n_errors")
    )
