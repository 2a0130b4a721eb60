"""SentencePiece encoding and decoding on the ``tokenizers`` library.

``read_model`` parses a SentencePiece model file (protocol buffer wire format)
and ``build`` makes an equivalent ``tokenizers`` pipeline:

* normaliser: the precompiled character map if the model has one, collapsing
  of spaces if asked for, the dummy prefix and the metaspace marker U+2581;
* model: Unigram with the pieces' scores, or BPE whose merges are derived from
  the scores (a piece of higher score is merged earlier), with byte fallback;
* decoder: marker to space, byte pieces to bytes, dummy prefix removed.

No piece of the usual vocabularies has the marker behind another character.
If so, a normalised text falls into units (a run of markers and what follows)
that are encoded and decoded independently, which changes no result: ``Codec``
hands each distinct unit to the library once per task (it forgets them beyond ``KEPT`` bytes).  Otherwise, and for
models that normalise more than spaces, texts go in whole.

Batches of bounded size are encoded by the library's own threads (``threads``
per task).  Every encoding is decoded again and compared with the text, and
``verify`` compares the ids with those that the ``sentencepiece`` library
itself gives, for each distinct unit or for every whole text.  The model file is small and of fixed size; its bytes are read
once by the driver and broadcast.

Results: null and empty texts have no ids (``n_tokens`` 0, round trip true,
parity true).  A text that holds the marker character itself, or one that the
normaliser changes, does not round trip and says so.  Equal texts give equal
rows; other columns pass through whatever their names.
"""

from __future__ import annotations

import gc
import os
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import SAME, Chunk, extended, free_names, span_hashes, text_chunks, tidy, with_fields

#: Where the public tokenizer files lie (a parameter of every entry point).
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text encoded at once, and rows decoded at once.
BATCH_BYTES = 1 << 20
BATCH_ROWS = 256
#: Threads of the libraries in a task.
THREADS = 2

# Fixed values of the model format: kinds of pieces, kinds of models, marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of one protocol buffer message; values by wire type."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is not part of a model file")
        yield number, value


def read_model(data: bytes) -> PieceModel:
    out = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
                elif n == 40:
                    out.unknown_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.collapse_spaces = bool(v)
                elif n == 5:
                    out.escape_spaces = bool(v)
    if out.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return out


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs that form a piece, best score first; ties by the parts' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    ranked = sorted(((-score, i, p) for i, (p, score, kind) in enumerate(model.pieces) if kind == NORMAL and len(p) > 1))
    out = []
    for _, _, piece in ranked:
        halves = [(piece[:n], piece[n:]) for n in range(1, len(piece))]
        out += sorted((h for h in halves if h[0] in ids and h[1] in ids), key=lambda h: (ids[h[0]], ids[h[1]]))
    return out


def splits_safely(model: PieceModel) -> bool:
    """Whether no piece has the marker behind another character."""
    return all(MARK not in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def build(model: PieceModel, whole: bool = True):
    """The pipeline for whole texts, or for normalised units."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.pieces[model.unknown_id][0]
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown_id, model.byte_fallback)
    else:
        core = models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model), unk_token=unknown, fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    tokenizer = Tokenizer(core)
    user = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if user:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p in user])
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if whole:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if whole and splits_safely(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if whole and model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


@dataclass
class Coded:
    """Ids of all rows in a row (``offsets`` per row), and two checks per row."""

    ids: np.ndarray
    offsets: np.ndarray
    round_trip: np.ndarray
    parity: np.ndarray


class Known:
    """Units met by a task: bytes, ids and checks, found by hash."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)  # sorted; ``order`` gives the places below
        self.order = np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)
        self.ids = np.zeros(0, np.int32)
        self.start = self.size = self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.fine = self.equal = np.zeros(0, bool)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values())

    def missing(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.flatnonzero(self.keys[at] != keys)

    def places(self, keys: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.keys, keys)]

    def add(self, keys, text, size, ids, count, fine, equal) -> None:
        n = len(self.start)
        self.start = np.concatenate([self.start, len(self.text) + np.cumsum(size) - size])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count, dtype=np.int64) - count])
        self.text = np.concatenate([self.text, text])
        self.ids = np.concatenate([self.ids, ids])
        self.size = np.concatenate([self.size, size])
        self.count = np.concatenate([self.count, count])
        self.fine = np.concatenate([self.fine, fine])
        self.equal = np.concatenate([self.equal, equal])
        merged = np.concatenate([self.keys, keys])
        places = np.concatenate([self.order, np.arange(n, n + len(keys))])
        by_key = np.argsort(merged, kind="stable")
        self.keys, self.order = merged[by_key], places[by_key]


class Codec:
    """Encodes the rows of a chunk and checks the result."""

    #: Units handed over at once, and bytes of units remembered.
    PART, KEPT = 4096, 48 << 20

    def __init__(self, data: bytes, verify: str | None, threads: int = 1):
        self.threads = threads
        self.model = read_model(data)
        self._whole = None
        self.verify = verify
        self.judge = None
        self.known = Known()
        if verify:
            import sentencepiece

            self.judge = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        plain = not m.charsmap and not m.collapse_spaces and m.dummy_prefix and m.escape_spaces
        #: For models that only mark spaces, and whose pieces allow splitting.
        self.units = build(m, whole=False) if plain and splits_safely(m) else None

    @property
    def whole(self):
        """The pipeline for whole texts, built when a text needs it."""
        if self._whole is None:
            self._whole = build(self.model)
        return self._whole

    def encode(self, chunk: Chunk) -> Coded:
        if self.units is not None and MARK.encode() not in chunk.data.tobytes():
            coded = self._by_units(chunk)
            if coded is not None:
                return coded
        return self._by_texts(chunk)

    def _texts(self, chunk: Chunk) -> list[str]:
        raw, o = chunk.data.tobytes(), chunk.offsets.tolist()
        return [raw[a:b].decode("utf-8") for a, b in zip(o[:-1], o[1:], strict=True)]

    def _by_texts(self, chunk: Chunk) -> Coded:
        texts = self._texts(chunk)
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.whole.decode_batch(ids, skip_special_tokens=False)
        equal = [x == y for x, y in zip(ids, self.judge.encode(texts, num_threads=self.threads), strict=True)] if self.judge else []
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        return Coded(
            np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])), offsets,
            np.array([x == y for x, y in zip(texts, back, strict=True)], bool), np.array(equal, bool),
        )

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        """Have the library encode and decode the units at [start, end)."""
        raw = data.tobytes()
        spans = list(zip(start.tolist(), end.tolist(), strict=True))
        flat, counts, fine, equal = [], [], [], []
        for at in range(0, len(spans), self.PART):
            part = [raw[a:b].decode("utf-8") for a, b in spans[at : at + self.PART]]
            ids = [e.ids for e in self.units.encode_batch_fast([u.replace(" ", MARK) for u in part], add_special_tokens=False)]
            back = self.units.decode_batch(ids, skip_special_tokens=False)
            fine += [x == y for x, y in zip(part, back, strict=True)]
            if self.verify == "units":
                # As a text of its own a unit gets the prefix that it already has; an
                # empty text gets none, so a single space is judged behind a letter.
                theirs = self.judge.encode([u[1:] for u in part], num_threads=self.threads)
                if " " in part:
                    theirs[part.index(" ")] = self.judge.encode("a ")[len(self.judge.encode("a")) :]
                equal += [x == y for x, y in zip(ids, theirs, strict=True)]
            counts += [len(x) for x in ids]
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids))))
        text = np.frombuffer(b"".join([raw[a:b] for a, b in spans]), np.uint8)
        self.known.add(keys, text, end - start, np.concatenate(flat), np.array(counts, np.int32), np.array(fine, bool), np.array(equal or fine, bool))

    def _by_units(self, chunk: Chunk) -> Coded | None:
        """Each distinct unit (spaces and what follows them) goes to the library once."""
        some = np.flatnonzero(np.diff(chunk.offsets))
        data = np.insert(chunk.data, chunk.offsets[:-1][some], 32)  # the dummy prefix
        offsets = chunk.offsets + np.searchsorted(some, np.arange(chunk.rows + 1))
        space = data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offsets[:-1][some]] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(data))[: len(start)]
        key = span_hashes(data, start, end, SAME)
        keys, first, which = np.unique(key, return_index=True, return_inverse=True)
        if self.known.nbytes > self.KEPT:
            self.known = Known()
        fresh = self.known.missing(keys)
        if len(fresh):
            self._learn(data, start[first[fresh]], end[first[fresh]], keys[fresh])
        known = self.known
        at = known.places(keys)[which]
        # Units of equal hash must be equal bytes; otherwise whole texts are encoded.
        size = end - start
        if (size != known.size[at]).any():
            return None
        within = np.arange(len(data)) - np.repeat(start, size)
        if (known.text[np.repeat(known.start[at], size) + within] != data).any():
            return None
        each = known.count[at].astype(np.int64)
        stop = np.cumsum(each)
        ids = known.ids[np.repeat(known.first[at] - (stop - each), each) + np.arange(int(stop[-1]) if len(stop) else 0)]
        unit_at = np.searchsorted(start, offsets)
        id_offsets = np.concatenate(([0], stop))[unit_at]

        def every(flags: np.ndarray) -> np.ndarray:
            bad = np.concatenate(([0], np.cumsum(~flags[at])))
            return bad[unit_at[1:]] == bad[unit_at[:-1]]

        parity = every(known.equal) if self.verify == "units" else np.zeros(0, bool)
        if self.verify == "texts":
            theirs = self.judge.encode(self._texts(chunk), num_threads=self.threads)
            parity = np.array([ids[a:b].tolist() == t for a, b, t in zip(id_offsets[:-1], id_offsets[1:], theirs, strict=True)], bool)
        return Coded(ids, id_offsets, every(known.fine), parity)


def encode(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text_col: str = "text",
    model_path: str = MODEL_PATH,
    threads: int = THREADS,
    verify: str | None = "units",
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with (ids, n_tokens, round_trip, parity); also returns their names.

    ``verify`` compares with the ``sentencepiece`` library: "units" (each
    distinct unit), "texts" (every whole text again) or None (``parity`` null).
    """
    with open(model_path, "rb") as file:  # the driver's own file, a few hundred KB
        sent = spark.sparkContext.broadcast(file.read())
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "round_trip": T.BooleanType(), "parity": T.BooleanType()}
    names = dict(zip(kinds, free_names(docs, *kinds), strict=True))
    schema = with_fields(docs, [(names[k], t) for k, t in kinds.items()])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        collecting = gc.isenabled()
        gc.disable()  # millions of small lists, no cycles
        try:
            codec = Codec(sent.value, verify, threads)
            for batch in batches:
                for chunk in text_chunks(batch.column(text_col), BATCH_BYTES):
                    coded = codec.encode(chunk)
                    parity = pa.array(coded.parity) if verify else pa.nulls(chunk.rows, pa.bool_())
                    lists = pa.ListArray.from_arrays(pa.array(coded.offsets.astype(np.int32)), pa.array(coded.ids))
                    yield extended(
                        batch.slice(chunk.first, chunk.rows), list(names.values()),
                        [lists, pa.array(np.diff(coded.offsets)), pa.array(coded.round_trip), parity],
                    )
        finally:
            if collecting:  # the worker goes on to other tasks
                gc.enable()

    return docs.mapInArrow(tidy(run), schema), names


def decode(spark: SparkSession, encoded: DataFrame, *, ids_col: str = "ids", model_path: str = MODEL_PATH, threads: int = THREADS) -> tuple[DataFrame, str]:
    """``encoded`` with the text of its ids (null ids: null); also returns the column's name."""
    with open(model_path, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    (name,) = free_names(encoded, "decoded")
    schema = with_fields(encoded, [(name, T.StringType())])

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        tokenizer = build(read_model(sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                ids = part.column(ids_col).to_pylist()
                texts = tokenizer.decode_batch([x or [] for x in ids], skip_special_tokens=False)
                yield extended(part, [name], [pa.array([None if x is None else t for x, t in zip(ids, texts, strict=True)], pa.string())])

    return encoded.mapInArrow(tidy(run), schema), name


def encoded_documents(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The registered query: one row per document, its ids as a digest."""
    coded, at = encode(spark, docs.select("doc_id", "text"), **options)
    return coded.select(
        "doc_id", at["n_tokens"],
        F.sha2(F.concat_ws(",", F.col(at["ids"]).cast("array<string>")), 256).alias("ids_sha256"),
        at["round_trip"], at["parity"],
    )
