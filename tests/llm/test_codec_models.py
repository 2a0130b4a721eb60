"""SentencePiece models written here: Unigram scores, byte fallback, threads, forgetting."""

import struct

import pytest

from larder.llm import sentencepiece_codec as codec


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(int(value))


def unigram_model(byte_fallback):
    """A Unigram model over a few pieces, as a SentencePiece file."""
    words = ["the", "cat", "sat", "on", "mat", "th", "e", "ca", "at", "s", "t", "he", "m", "a", "o", "n", "c", "h", "u", "é"]
    pieces = [("<unk>", 0.0, codec.UNKNOWN), ("<s>", 0.0, codec.CONTROL), ("</s>", 0.0, codec.CONTROL)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, codec.BYTE) for i in range(256)]
    pieces += [(codec.MARK, -2.0, codec.NORMAL)]
    pieces += [(codec.MARK + w, -3.0 - 0.37 * i, codec.NORMAL) for i, w in enumerate(words)]
    pieces += [(w, -4.5 - 0.53 * (i * 7 % 20), codec.NORMAL) for i, w in enumerate(words)]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, kind)) for p, s, kind in pieces)
    out += field(2, field(3, 1) + field(35, byte_fallback))
    return out + field(3, field(1, b"identity") + field(3, True) + field(4, False) + field(5, True))


@pytest.fixture(params=[False, True])
def model_path(request, tmp_path):
    path = tmp_path / "small.model"
    path.write_bytes(unigram_model(request.param))
    return str(path)


TEXTS = ["the cat sat on the mat", "  the  thecat é", "", None, "that hat", "u" * 50, "the cat\nsat ", "matter of the moon"]


def test_unigram_scores_and_fallback(spark, model_path):
    import sentencepiece

    judge = sentencepiece.SentencePieceProcessor(model_file=model_path)
    fallback = judge.is_byte(3)
    texts = TEXTS + (["日本 x ☃"] if fallback else [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for verify in ("units", "texts"):
        coded, at = codec.encode(spark, docs, model_path=model_path, verify=verify, threads=3)
        back, name = codec.decode(spark, coded, ids_col=at["ids"], model_path=model_path, threads=3)
        for r in back.collect():
            assert r[at["ids"]] == judge.encode(r["text"] or "") and r[at["parity"]], r["text"]
            if fallback or "\n" not in (r["text"] or ""):
                known = all(i != judge.unk_id() for i in r[at["ids"]])
                assert r[at["round_trip"]] == known and (not known or r[name] == (r["text"] or ""))


def test_units_are_forgotten_by_bytes_and_give_the_same_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"word{j}x{i}" for j in range(300))) for i in range(40)], "doc_id long, text string").coalesce(1)

    def ids(**options):
        coded, at = codec.encode(spark, docs, **options)
        return sorted((r["doc_id"], r[at["ids"]], r[at["parity"]], r[at["round_trip"]]) for r in coded.collect())

    want = ids()
    monkeypatch.setattr(codec, "BATCH_BYTES", 1 << 12)
    monkeypatch.setattr(codec.Codec, "KEPT", 1 << 14)
    assert ids(threads=1) == want and all(r[2] and r[3] for r in want)


def test_collection_of_garbage_is_back_after_a_task(spark):
    import gc

    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    coded, at = codec.encode(spark, docs)

    def after(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([gc.isenabled()])], names=["on"])

    coded.collect()
    assert spark.range(4).mapInArrow(after, "on boolean").where("not on").count() == 0
