"""Every stage of the pipeline on its own input, against plain versions."""

import hashlib
import math

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from claimloom.llm import tokenids

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    found = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    extra = spark.createDataFrame([(901, "123 456", "en", "src1", 7), (902, None, None, None, None), (903, "", "de", None, 0)], found.schema)
    docs, out = found.unionByName(extra), []
    for name, stage in pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, SF).cache()
        out.append((name, before, [tuple(r) for r in docs.collect()], docs.columns))
    return out


def test_columns(stages):
    assert all(columns == pipeline.COLUMNS for *_, columns in stages[:-1])


def test_language_rejects_texts_without_letters(stages):
    _, before, after, _ = stages[0]
    assert {r[0] for r in before} - {r[0] for r in after} == {901, 902, 903}


def test_language_rejects_other_scripts_and_junk_and_writes_the_language(spark):
    found = spark.read.parquet(f"{SF}/documents.parquet").select(*pipeline.COLUMNS)
    known = [tuple(r) for r in found.collect()]
    german = max((r for r in known if r[2] == "de"), key=lambda r: len(r[1]))
    extra = [(901, "Это обычный текст на русском языке о погоде", None, "src1", 1), (902, "これは日本語の文章です。天気について", None, "src1", 1),
             (903, "qxzvkw jjqxz wvvkqz xkcdqj zzxqvw kqjxzv " * 5, None, "src1", 1), (904, "x", None, "src1", 1),
             (905, german[1], None, "src1", 1), (906, german[1] + " ", "fr", "src1", 1)]
    out = {r[0]: tuple(r) for r in pipeline.language_id(spark, found.unionByName(spark.createDataFrame(extra[:5], found.schema)), SF).collect()}
    assert set(out) & {r[0] for r in extra} == {905} and out[905] == (905, german[1], "de", "src1", 1)
    assert {r[0] for r in known} <= set(out)
    out = {r[0]: r["lang"] for r in pipeline.language_id(spark, found.filter("doc_id % 2 = 0 OR lang = 'de'").unionByName(spark.createDataFrame(extra[5:], found.schema)), SF).collect()}
    assert out[906] == "de"


def test_one_of_every_group_stays(stages):
    _, before, after, _ = stages[1]
    keep = {r[0] for r, (n, c) in zip(before, brute.near([(r[0], r[1]) for r in before], 5)) if n == 0 or c == r[0]}
    assert sorted(after) == sorted(r for r in before if r[0] in keep) and len(keep) < len(before)


def test_contaminated_go(spark, stages):
    _, before, after, _ = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r, (n, hit, _) in zip(before, brute.phrases([r[1] for r in before], items)) if not (hit and 20 * hit >= n)]
    assert sorted(after) == sorted(clean) and len(clean) < len(before)


def test_copies_follow_the_draw(stages):
    _, before, after, _ = stages[3]
    sizes = {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1])
    wanted = sum(math.sqrt(n) for n in sizes.values())
    copies = []
    for r in before:
        rate = math.sqrt(sizes[r[3]]) / wanted * sum(sizes.values()) / sizes[r[3]]
        u = int(hashlib.md5(f"mix-1|{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        n, term = 0, math.exp(-rate)
        total = term
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        copies += [r] * n
    assert sorted(after) == sorted(copies)


def test_ids_are_stored(stages):
    _, before, after, columns = stages[4]
    library = tokenids.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    own = {r[:2]: [*library.encode(r[1], add_special_tokens=False).ids, 1] for r in before}
    assert columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((r[0], r[2], r[3]) for r in after) == sorted((r[0], len(own[r[:2]]), brute.crc(own[r[:2]])) for r in before)
    # One after the other without a gap, in mixed order: not by id, and copies apart.
    stored = sorted(after, key=lambda r: r[1])
    assert [r[1] for r in stored] == [sum(x[2] for x in stored[:i]) for i in range(len(stored))]
    ids = [r[0] for r in stored]
    assert ids != sorted(ids)
    assert sum(x == y for x, y in zip(ids, ids[1:])) < (len(ids) - len(set(ids))) / 2


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
