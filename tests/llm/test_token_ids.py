"""Token ids: work per id of the coder and of the tokenizer, and texts of mixed characters."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from claimloom.llm import rangecoder, tokenids

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_steps_of_the_coder_do_not_grow_with_a_block(monkeypatch):
    steps, update = [], rangecoder._Model.update
    monkeypatch.setattr(rangecoder._Model, "update", lambda self, *given: (steps.append(1), update(self, *given))[1])
    ids = np.minimum(np.random.default_rng(1).zipf(1.2, 60000), 49407)
    blocks = rangecoder.encode(ids, 49408)
    assert len(blocks) == 1 and len(steps) <= 256
    assert (rangecoder.decode(blocks, 49408) == ids).all()
    assert len(blocks[0][2]) < 2 * len(ids)


def test_blocks_of_any_length_and_damage_in_the_lengths():
    rng = np.random.default_rng(2)
    for size in (1, 255, 256, 257, 511, 512, 513, 2000):
        for ids in (rng.integers(0, 300, size), np.full(size, 299), np.arange(size) % 300):
            assert (rangecoder.decode(rangecoder.encode(ids, 300), 300) == ids).all()
    (n, crc, data), = rangecoder.encode(np.arange(2000) % 300, 300)
    for cut in (data[:-4], data[:3], b"", data[:6] + bytes([data[6] ^ 4]) + data[7:], data + b"\0\0\0\0"):
        try:
            rangecoder.decode([(n, crc, cut)], 300)
        except ValueError as error:
            assert "checksum" in str(error)
        else:
            raise AssertionError("damage was not found")


def test_every_piece_is_asked_for_once():
    class Counting:
        def __init__(self, library):
            self.library, self.asked = library, []

        @property
        def model(self):
            return self

        def tokenize(self, piece):
            self.asked.append(piece)
            return self.library.model.tokenize(piece)

        def encode_batch_fast(self, texts, **given):
            self.asked += [p for t in texts for p in t.split(" ")]
            return self.library.encode_batch_fast(texts, **given)

    known = tokenids._pieces(WORD_BPE)
    known.forget()
    counting, library = Counting(known.library), known.library
    known.library = counting
    try:
        for _ in range(3):
            tokenids.encode_texts(pa.array(["Some words, some WORDS", "more words 12"]), WORD_BPE)
    finally:
        known.library = library
    assert sorted(counting.asked) == sorted({"some", "words", ",", "more", "1", "2"})


def test_mixed_characters_and_a_full_table(monkeypatch):
    monkeypatch.setattr(tokenids, "KNOWN_PIECES", 300)
    rng, library = random.Random(3), tokenids.tokenizer(WORD_BPE)
    plain = ["a", " ", "  ", "\n", "'", "'s", "'S", "'re", "'r", "!", "23", "é", "É", "the", "THE", "don't", " ", "\u0085", "²", "½", "ß", "ĳ", "ÿ", "--'s", "'ve", "°", "ɏ", "Ŵ"]
    for parts in (plain, [*plain, "ɐ", "漢", "<|endoftext|>", "<|endo", "İ", "ǅ", "́", "’"]):
        for _ in range(4):
            texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(200)] + ["", None, "q" * 700]
            ids, offs = tokenids.encode_texts(pa.array(texts, pa.string()), WORD_BPE)
            for i, text in enumerate(texts):
                assert ids[offs[i] : offs[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    known = tokenids._pieces(WORD_BPE)
    assert (known.at[: len(known.row) + 1] <= len(known.ids)).all()


def test_bytes_that_are_not_text():
    raw = b"a\xc3b\xa9\xc3\xa9\xff \xc3"
    texts = pa.Array.from_buffers(pa.binary(), 4, [None, pa.py_buffer(np.array([0, 3, 6, 8, 9], np.int32)), pa.py_buffer(raw)]).view(pa.string())
    ids, offs = tokenids.encode_texts(texts, WORD_BPE)
    library = tokenids.tokenizer(WORD_BPE)
    for i, part in enumerate((raw[0:3], raw[3:6], raw[6:8], raw[8:9])):
        assert ids[offs[i] : offs[i + 1]].tolist() == library.encode(part.decode(errors="replace"), add_special_tokens=False).ids
