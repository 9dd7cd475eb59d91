"""The text operators against plain versions, on documents with nulls, blanks, repeated rows and clashing columns."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from claimloom.llm import bpe, decontaminate, fmindex, language, licenses, mixing, neardup, oracles, quality, queries, rangecoder, tables, tokencounts, tokenids, toxicity, windows
from contract import compare

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, score string, n_words string, _text string"
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows(spark):
    """Some documents, and rows that are null, blank, repeated, without an id, near-copies or long."""
    found = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    near = [" ".join(f"x{i}" if k == 40 * i else w for k, w in enumerate(base)) for i in range(1, 6)]
    odd = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "One"), (905, "two words"), (905, "two words"), (905, "same id, another text"),
           (None, "a text without an id"), (None, None), (906, "<|endoftext|> in a text<|endoftext|>"), (907, "漢字 ß İ ǅ don't WE'LL ''s\r\n  x  "),
           (908, "a b c " * 400), (909, " ".join(rng.choice("abc") for _ in range(3000))), (910, "z" * 3000),
           *((920 + i, t) for i, t in enumerate(near)), (940, near[0]), (941, near[0].upper())]
    return [*found, *((i, t, None, None, None) for i, t in odd)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "n", "s", "w", "t") for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_near_duplicates(docs, rows, empty):
    want = [(r[0], n, c if n else r[0], r[0] == (c if n else r[0])) for r, (n, c) in zip(rows, brute.near([(r[0], r[1]) for r in rows], 4))]
    got = neardup.near_duplicates(docs, width=4).cache()
    assert bag(got, "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=repr)
    by_component = {}
    for r in got.filter("n_shingles > 0").select("component_id", "row_key", "survives").distinct().collect():
        by_component[r[0]] = by_component.get(r[0], 0) + r[2]
    assert all(n == 1 for c, n in by_component.items() if c not in (None, 905))  # two texts share that id
    assert neardup.near_duplicates(empty).count() == 0


def test_mixed_bucket_search_finds_links_that_no_bucket_head_has():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k * 15 :], rng.integers(0, 2**63, k * 15).astype(np.uint64)])) for k in range(6)]
    sig = [neardup.signature(s) for s in sets]
    sig = [np.concatenate([sig[0][: neardup.ROWS], x[neardup.ROWS :]]) for x in sig]  # all meet in the first band
    key = int(neardup._bands(np.stack(sig))[0, 0])
    table = pa.table({"key": pa.array([key] * 6), "i": pa.array([0] * 6, pa.int32()), "j": pa.array([0] * 6, pa.int32()), "node": pa.array(range(6)), "root": pa.array(range(6)), "sig": pa.array([s.astype("<u4").tobytes() for s in sig]), "first": [True] * 6, "second": [True] * 6})
    cell = neardup._search_cell(80)(table)
    nodes, left, right = cell["nodes"][0].as_py(), *(np.frombuffer(cell[c][0].as_py(), "<u4") for c in ("left", "right"))
    found = {(nodes[x], nodes[y]) for x, y in zip(left, right)}
    exact = {(a, b) for a in range(6) for b in range(a + 1, 6) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert exact <= found and len(exact) >= 3
    meet = pa.concat_tables([cell, pa.table({"node": pa.array(nodes), "set": pa.array([sets[n].astype("<u8").tobytes() for n in nodes], pa.binary())})], promote_options="default")
    links = neardup._confirm_cell(80)(meet).to_pydict()
    assert set(zip(links["a"], links["b"])) <= exact and {*links["a"], *links["b"]} == {x for pair in exact for x in pair}
    assert neardup.least_matches(80) == sorted(neardup.least_matches(80))


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 101), (7, 7)] + [(200, k) for k in range(201, 260)]
    from claimloom.llm.components import components

    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in (101, 102)}, **{i: 200 for i in range(201, 260)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [3, 35])
def test_substring_windows(docs, rows, empty, width):
    want = sorted(((r[0], *w) for r, w in zip(rows, brute.windows([r[1] for r in rows], width))), key=repr)
    cut = windows.remove_repeats(docs, width=width)
    assert bag(cut, "doc_id", "n_words", decontaminate.span_words("removed"), F.sha2(F.col("text").cast("binary"), 256)) == want
    assert windows.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("block", [8 << 20, 700])
def test_decontamination(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(501, "two WORDS"), (502, None), (503, ""), (504, rows[3][1][:400]), (505, rows[3][1][:400]), (None, "a text without")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((r[0], *w) for r, w in zip(rows, brute.phrases([r[1] for r in rows], items))), key=repr)
    got = decontaminate.find_phrases(docs, benchmark, carry=["doc_id"])
    assert bag(got, "doc_id", "n_words", decontaminate.span_words(), "items") == want
    assert sum(w[2] > 0 for w in want) > 3
    assert decontaminate.find_phrases(empty, benchmark, carry=["doc_id"]).count() == 0
    none = decontaminate.find_phrases(docs, benchmark.limit(0), carry=["doc_id"])
    assert none.filter("size(items) > 0 OR size(spans) > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 5, 3000)
    index = fmindex.FMIndex(text, 4)
    patterns = np.array([[1, 2, 3], [4, 4, 0], [2, 0, 0], [1, 1, 1]])
    low, high = index.search(patterns, (patterns > 0).sum(axis=1))
    for p, a, b in zip(patterns, low, high):
        p = p[p > 0]
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]


def test_prefix_token_counts():
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "'", "'s", "'re", "'r", "!", "23", "é", "漢", "<|endoftext|>", "<|endo", "|>", "the", " of", "\r\n", "ᲊ", "don't", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", None, " ", "q" * 700]
    library = tokencounts.tokenizer(BYTE_BPE)
    for text, counts in zip(texts, tokencounts.counts_of_batch(pa.array(texts, pa.string()), BYTE_BPE)):
        text = text or ""
        step = 1 if len(text) < 100 else 50
        for k in range(step, len(text) + 1, step):
            assert counts[k - 1] == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)
        assert (tokencounts.unpack_counts(tokencounts.pack_counts(counts)) == counts).all()


def test_token_counts(docs, rows, empty):
    library = tokencounts.tokenizer(BYTE_BPE)
    want = sorted(((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    got = tokencounts.count_tokens(docs, BYTE_BPE, carry=["doc_id"], budget=20).cache()
    assert bag(got, "doc_id", "n_bytes", "n_tokens") == want
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 900}
    for r in got.filter("doc_id < 900").limit(20).collect():
        assert len(library.encode(texts[r.doc_id][: r.fits], add_special_tokens=False).ids) <= 20
    assert tokencounts.count_tokens(empty, BYTE_BPE, carry=["doc_id"]).count() == 0


def test_long_pieces_have_the_same_table():
    model = bpe.BytePairs.from_file(BYTE_BPE)
    piece = ("internationalisation" * 20).encode()
    assert (model.prefix_counts_of(piece) == model.prefix_counts(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))).all()


def test_range_coder_round_trip_and_damage():
    rng = np.random.default_rng(0)
    for ids in (np.array([5]), np.zeros(9000, int), rng.integers(0, 49408, 2500), np.minimum(rng.zipf(1.3, 5000), 49407)):
        blocks = rangecoder.encode(ids, 49408, 1024)
        assert (rangecoder.decode(blocks, 49408) == ids).all()
        assert (rangecoder.decode(blocks[1:2], 49408) == ids[1024:2048]).all()  # blocks stand alone
    assert len(rangecoder.encode(np.zeros(0, int), 10)) == 0
    n, crc, data = blocks[0]
    with pytest.raises(ValueError, match="checksum"):
        rangecoder.decode([(n, crc, bytes([data[0] ^ 1]) + data[1:])], 49408)


def test_token_ids(docs, rows, empty):
    library = tokenids.tokenizer(WORD_BPE)
    got = [tuple(r) for r in tokenids.stored_ids(docs, WORD_BPE).drop("ids").orderBy("start").collect()]
    assert [r[0] is not None for r in got] == sorted(r[0] is not None for r in got)
    assert [r[0] for r in got if r[0] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = sorted(((r[0], len(ids), brute.crc(ids)) for r in rows for ids in [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1]]), key=repr)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == want
    assert tokenids.stored_ids(empty, WORD_BPE).count() == 0


def test_quality_counts(docs, rows, empty):
    want = sorted(((r[0], *brute.quality(r[1])) for r in rows), key=repr)
    got = quality.quality_rules(docs).cache()
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    assert got.filter("base_failed != (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) OR (kept AND base_failed)").count() == 0
    assert quality.quality_rules(empty).count() == 0


def test_js_distance(spark):
    a, b = [3, 0, 5, 2], [1, 4, 0, 5]
    p, q = np.array(a) / 10, np.array(b) / 10
    m = (p + q) / 2
    want = np.sqrt(sum(0.5 * x * np.log2(x / y) for v in (p, q) for x, y in zip(v, m) if x))
    got = spark.createDataFrame([(a, b), (a, a), (a, [0, 0, 0, 0])], "a array<long>, b array<long>").select(quality.js_distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx(want) and got[1][0] == 0 and got[2][0] is None


def test_mixing(spark, docs, rows, empty):
    con = compare.oracle(SF)
    ok, note = compare.compare(spark, con, queries.op1_mix_sources, oracles.MIX_SOURCES, SF)
    assert ok, note
    mixed = mixing.mix_sources(docs, {"src0": 1.0}).cache()
    assert {r.source for r in mixed.select("source").distinct().collect()} <= {"src0"}
    assert mixed.columns == [*docs.columns, "copy", "mix_key"]
    assert mixing.mix_sources(docs).count() > 0  # a null source is a source
    assert mixing.mix_sources(empty).count() == 0
    steps = spark.sql("select 0.0D r union all select 2.5D union all select 900D").select("r", mixing.poisson_steps(F.col("r")).alias("s")).collect()
    assert steps[0].s == [1.0]
    for r in steps[1:]:
        assert abs(r.s[-1] - 1) < 1e-9 and abs(sum(1 - x for x in r.s) - r.r) < 1e-6  # the mean


def test_licenses(docs, rows, empty):
    got = licenses.scan_licenses(docs.unionByName(docs.limit(1).withColumn("text", F.lit("x y " * 30 + licenses.TEMPLATES["MIT grant"] + " z" * 9)).withColumn("doc_id", F.lit(777).cast("long"))))
    found = {(r.doc_id, r.license, r.first, r.end) for r in got.collect()}
    assert (777, "MIT grant", 60, 60 + len(brute.ALNUM.findall(licenses.TEMPLATES["MIT grant"]))) in found
    for doc, text, *_ in rows:
        words = brute.ALNUM.findall(brute.low(text))
        for name, notice in licenses.TEMPLATES.items():
            own = brute.ALNUM.findall(brute.low(notice))
            for i in range(len(words) - len(own) + 1):
                if words[i : i + len(own)] == own:
                    assert any(f[0] == doc and f[1] == name and f[2] <= i and f[3] >= i + len(own) for f in found)
    assert licenses.scan_licenses(empty).count() == 0


def test_language_held_out(spark, docs, rows, empty):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    filters = language.learn_filters(docs)
    named = language.identify(docs, filters, carry=["doc_id"])
    assert {(r.doc_id, r.lang_pred, r.score) for r in named.filter("doc_id in (900, 901, 902)").collect()} == {(i, "und", 0.0) for i in (900, 901, 902)}
    assert named.count() == len(rows) and named.filter("score < 0 or score > 1").count() == 0
    assert language.identify(empty, filters, carry=["doc_id"]).count() == 0
    assert language.identify(docs, language.learn_filters(empty), carry=["doc_id"]).filter("lang_pred != 'und'").count() == 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id", "left_semi")
    learn = tables.learn_rows(F.col("doc_id"), 3, 1)
    model = toxicity.learn_toxicity(known.filter(learn), labels.filter(learn))
    return model, toxicity.score_toxicity(known.filter(~learn), model, carry=["doc_id", "lang"]).join(labels, "doc_id").toPandas()


def test_toxicity_held_out(spark, docs, rows, empty, toxic_model):
    model, held = toxic_model
    above = (held[held.toxic == 1].score.to_numpy()[:, None] > held[held.toxic == 0].score.to_numpy()).mean()
    assert above > 0.9
    assert toxicity.score_toxicity(docs, model, carry=["doc_id"]).count() == len(rows)
    nothing = toxicity.learn_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, nothing, carry=["doc_id"]).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, model, carry=["doc_id"]).count() == 0


def test_toxic_wording_is_found_in_every_language(toxic_model):
    held = toxic_model[1]
    recall = {lang: float((own.score >= 0.7).mean()) for lang, own in held[held.toxic == 1].groupby("lang")}
    precision = held[held.score >= 0.7].toxic.mean()
    print("recall", recall, "all", (held[held.toxic == 1].score >= 0.7).mean(), "precision", precision, "n", held[held.toxic == 1].groupby("lang").size().to_dict())
    assert set(recall) == {"en", "de", "fr", "es"} and min(recall.values()) > 0.45 and precision > 0.95
    assert (held[held.toxic == 1].score >= 0.7).mean() > 0.8


def test_scores_come_from_compressed_lengths_alone(monkeypatch):
    """A stem that only toxic texts have is found by what it saves; without the toxic dictionary nothing is left of it."""
    rng = random.Random(3)
    text = lambda n: " ".join([*(f"w{rng.randrange(300)}" for _ in range(60)), *(f"grolmix{rng.choice('abcdef')}" for _ in range(n))])
    toxic, ordinary = [text(rng.randrange(3, 6)) for _ in range(60)], [text(0) for _ in range(300)]
    model = toxicity.train(toxic[:40], ordinary[:200])
    for own in (*toxic[40:44], "", None, "x " * 50_000):
        plain, both = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=zstandard.ZstdCompressionParameters(
            compression_level=3, strategy=zstandard.STRATEGY_LAZY2, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)) for c in (model.ordinary, model.toxic + model.ordinary))
        want = [(len(w), len(plain.compress(w)), len(both.compress(w))) for w in toxicity.windows(own)]
        assert toxicity.lengths(own, model).tolist() == [list(map(float, w)) for w in want]
    saved = lambda t, m: np.subtract(*toxicity.lengths(t, m).T[1:]).max()
    assert min(saved(t, model) for t in toxic[40:]) > np.mean([saved(t, model) for t in ordinary[200:]])
    blank = toxicity.Toxicity(model.ordinary, b"")
    assert all(saved(t, blank) == 0 for t in toxic[40:])
    # The same lengths are the same features, whatever the words were.
    monkeypatch.setattr(toxicity, "lengths", lambda t, m: np.array([[90.0, 40.0, 37.0], [80.0, 50.0, 50.0]]))
    assert toxicity.features("one text", model) == toxicity.features("another", blank)


def test_ladders_keep_whole_texts():
    toxicity._LADDERS.clear()
    assert toxicity.windows("Trash, a ") == [b" tr tra tras trash a "] and toxicity.windows(None) == toxicity.windows(" \n") == [b" "]
    assert len(toxicity.windows("word " * 16_001)) == 1001


def test_toxic_scores_do_not_move_with_the_size_of_the_input(monkeypatch):
    """A sample cut by both caps gives the scores that all rows give."""
    monkeypatch.setattr(toxicity, "MAX_TOXIC", 1000)
    monkeypatch.setattr(toxicity, "MAX_ORDINARY", 3000)
    rng, nothing = np.random.default_rng(2), toxicity.Toxicity(b"", b"")
    toxic = np.repeat([1.0, 0.0], [4400, 35600])
    rows = np.stack([np.ones(len(toxic)), rng.normal(1.5 * toxic)], axis=1)
    cut = np.r_[0:1000, 4400:7400]
    whole = toxicity.fit(nothing, rows, toxic, toxicity.sample_shift(1000, 3000))
    part = toxicity.fit(nothing, rows[cut], toxic[cut], toxicity.sample_shift(4400, 35600))
    uncorrected = toxicity.fit(nothing, rows[cut], toxic[cut])
    at = np.array([[1.0, x] for x in (0.0, 1.0, 2.0, 3.0)])
    a, b, c = (toxicity.score(at, m) for m in (whole, part, uncorrected))
    print("whole", a, "corrected", b, "uncorrected", c)
    assert np.abs(a - b).max() < 0.06 < np.abs(a - c).max()
