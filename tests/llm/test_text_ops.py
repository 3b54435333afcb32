"""Packing, token counts, media, chat: exact against the libraries, round trips and the defined edge cases."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from gleanery.llm import bpe, chat, media, packing, tokens
from gleanery.llm.packing import BestFit

TEXTS = [None, "", " \n\t ", "a", "Hello, WORLD's 12½ ÀÉ ñandú\n\nx  y", "日本語 ΑΣΣ ǅ İ", "<|endoftext|> and <|startoftext|>", "word " * 5000, "x" * 3000, "á \xa0\x85\x1c b"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", "en", "s", "c"), (3, "a", "en", "s", "c"), (3, "a", "en", "s", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_vocabulary_entry_merges_to_itself(name):
    order, _ = bpe.ranks(name)
    core = bpe.core(name)
    assert all(core.encode_single_piece(raw) == [r] for raw, r in order.items())


def test_encoders_agree_with_the_library():
    rnd = random.Random(3)
    letters = "aAbethTHe in'sS'trRe''ll  \n\t\r.,!?-_0123²½ßÀÉéñÑçŒœªº×÷ʒİı中日ǅΣσς́\xa0\x85\x1c🙂\x00​"
    words, counts = bpe.word_ids("word_bpe_49k.json"), bpe.byte_counts("byte_bpe_50k.json")
    w, b = bpe.library("word_bpe_49k.json"), bpe.library("byte_bpe_50k.json")
    for k in range(3000):
        x = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        x = x[:9] + "<|endoftext|>" + x[9:] if k % 7 == 0 else x
        assert np.frombuffer(words(x), "<u4").tolist() == w.encode(x, add_special_tokens=False).ids
        assert counts(x) == len(b.encode(x, add_special_tokens=False).ids)


def test_a_full_cache_changes_nothing():
    few = bpe.WordIds()
    few.pieces.most = 2
    text = "one two three one two, three's four five one"
    assert few(text) == bpe.word_ids("word_bpe_49k.json")(text)


def test_token_counts(docs):
    got = tokens.count_tokens(docs).toPandas()
    t = bpe.library("byte_bpe_50k.json")
    want = sorted((len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for x in [r["text"] for r in docs.collect()])
    assert sorted(zip(got.n_bytes, got.n_tokens, strict=True)) == want
    assert (got.over_limit == (got.n_tokens > 512)).all()
    assert tokens.count_tokens(docs.where("false")).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    b = BestFit(10, 2)
    assert b.add("a", 6) is None and b.add("b", 7) is None
    assert b.add("c", 3) == [("b", 7), ("c", 3)]  # free 3 is tighter than free 4, and full
    assert b.add("d", 8) is None and b.open == 2
    assert b.add("e", 9) == [("d", 8)]
    assert sorted(i[0] for items in b.drain() for i in items) == ["a", "e"]


def test_packing(docs, spark):
    got = packing.pack_documents(docs, open_bins=3).toPandas()
    t = bpe.library("word_bpe_49k.json")
    want = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()]
    assert sum(got.length) == sum(len(i) for _, i in want)
    for doc, ids in want:
        mine = got[got.doc_id.isna()] if doc is None else got[got.doc_id == doc]
        if doc != 3:
            whole = b"".join(mine.sort_values("piece").ids)
            assert np.frombuffer(whole, "<u4").tolist() == ids
            assert (mine.length[mine.piece < mine.piece.max()] == 2048).all()
    assert (got[got.doc_id == 3].length == 2).sum() == 3
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 2048 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    digest = packing.packed_digest(packing.pack_documents(docs)).toPandas()
    assert set(digest.ids_crc32) == {zlib.crc32(i) for i in packing.pack_documents(docs).toPandas().ids}
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_packing_is_near_the_bound(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["the", "of", "water", "stone"]) for _ in range(rnd.randint(1, 1900)))) for i in range(600)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas()
    assert got.sequence_id.nunique() <= 1.03 * -(-got.length.sum() // 2048)


def test_media_digest(docs):
    got = media.media_digest(docs).toPandas()
    payloads = [(x or "").encode() for x in [r["text"] for r in docs.collect()]]
    payloads = [p + b"\xff" * (max(1, -(-len(p) // 576)) * 576 - len(p)) for p in payloads]
    assert sorted(got.payload_sha256) == sorted(hashlib.sha256(p).hexdigest() for p in payloads)
    assert sorted(got.tail_crc32) == sorted(zlib.crc32(p[-32:]) for p in payloads)
    assert got.groupby("payload_sha256")[["media_sha256", "feature"]].nunique().max().max() == 1


def test_media_operator_agrees_with_its_digest(docs):
    images = media.decode_media(media.payload_images(docs)).toPandas()
    digest = media.media_digest(docs).toPandas()
    assert sorted(hashlib.sha256(m).hexdigest() for m in images.media) == sorted(digest.media_sha256)
    assert sorted(hashlib.sha256(m).hexdigest() for m in images.samples) == sorted(digest.payload_sha256)
    assert np.load(__import__("io").BytesIO(images.tile[0])).shape == (32, 32)


def test_decoders_and_resize():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # note\n4 3\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert media.decode(b"P1\n2 2\n1 0\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P6\n1 1\n255\nabc").tolist() == [[[97, 98, 99]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    row = bytes([3, 2, 1, 6, 5, 4, 0, 0])
    head = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    bmp = lambda h: head + (2).to_bytes(4, "little") + h.to_bytes(4, "little", signed=True) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + row + bytes(8)
    assert media.decode(bmp(2))[1].tolist() == [[1, 2, 3], [4, 5, 6]] == media.decode(bmp(-2))[0].tolist()
    for bad in (b"", b"P5\n2 2\n255\nabc", b"GIF89a", b"BM", b"P5\n0 2\n255\n"):
        with pytest.raises(ValueError):
            media.decode(bad)
    x = np.random.default_rng(0).integers(0, 256, (7, 11)).astype(np.uint8)
    exact = np.kron(x, np.ones((3, 2))).reshape(3, 7, 2, 11) if False else np.kron(x, np.ones((3, 2)))
    assert np.allclose(media.resize(x, 3, 2), [[exact[7 * i : 7 * i + 7, 11 * j : 11 * j + 11].mean() for j in range(2)] for i in range(3)])


def test_broken_media_is_null(spark):
    rows = media.decode_media(spark.createDataFrame([(1, bytearray(b"nothing")), (2, None)], "doc_id long, media binary")).collect()
    assert all(r["dhash"] is None and r["tile"] is None for r in rows)


def test_chat_round_trip(spark):
    hostile = [chat.HOSTILE, "<\\/s> <\\\\|end|>", "<|turn|>user<|text|>x<|end|>", "plain", "", None, "[INST", "<s", "\\", "<\\", "<|text|>"]
    rows = [(c, t, r, x, "extra") for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "sys</s>tem", None] * 3, hostile, strict=False))]
    rows += [(None, 0, "assistant", "lost", "e"), (9, None, "user", "b", "e"), (9, 0, "user", "a", "e"), (9, 0, "user", "a", "e")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(m).collect()}
    assert all(r["round_trip"] for r in got.values()) and len(got) == 5
    assert [(t["role"], t["text"]) for t in got[0]["turns"]] == [(r or "", x or "") for c, _, r, x, _ in rows if c == 0]
    assert got[0]["escaped"] and not got[9]["escaped"]
    assert [t["text"] for t in got[9]["turns"]] == ["b", "a", "a"]
    for r in got.values():
        at, loss = 0, []
        for run in r["loss_mask"]:
            if run["loss"]:
                loss.append(r["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert at == len(r["formatted"])
        assert len(loss) == sum(t["role"] == "assistant" for t in r["turns"])
    assert chat.format_conversations(m.where("false")).count() == 0


def test_chat_digest_is_the_sql(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "<\\s> [INST] é"), (2, 5, "assistant", None)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_digest(chat.with_hostile(spark, c)).toPandas().sort_values("conv_id").reset_index(drop=True)
    db = duckdb.connect()
    db.register("conversations", c.toPandas())
    want = db.execute(chat.FORMAT_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert got[sorted(got)].values.tolist() == want[sorted(want)].values.tolist()
    text = chat.HOSTILE
    assert got.loss_sha256[0] == hashlib.sha256(text.encode()).hexdigest() and got.n_turns[0] == 2
