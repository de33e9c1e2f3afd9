"""SentencePiece models run by the tokenizers library, with parity checks against SentencePiece itself."""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from gridloom.llm.common import by_batch

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_BYTES = 64 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                length, at = _varint(data, at)
            elif kind in (1, 5):
                length = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, at = data[at : at + length], at + length
        yield tag >> 3, value


class SpModel:
    """What a SentencePiece model file says: pieces with score and kind, trainer and normaliser settings."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for field, value in wire_fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in wire_fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                normaliser = dict(wire_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix_mark = bool(trainer.get(24, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.words_split = not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k == NORMAL)
        self.newline_alone = not any("\n" in p for p, _, k in self.pieces if k == NORMAL)


def _merges(model: SpModel) -> list[tuple[str, str]]:
    """BPE merges: all splits of each normal piece into two, best-scored pieces first."""
    normal = {p: (-s, i) for i, (p, s, k) in enumerate(model.pieces) if k == NORMAL}
    found = [(rank, cut, piece) for piece, rank in normal.items() for cut in range(1, len(piece)) if piece[:cut] in normal and piece[cut:] in normal]
    return [(p[:cut], p[cut:]) for _, cut, p in sorted(found)]


def decoder_of(prefixed: bool) -> decoders.Decoder:
    """Marks become spaces and byte pieces bytes; `prefixed`: the mark put in front goes."""
    return decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if prefixed else [])])


def build_tokenizer(model: SpModel):
    """A tokenizers.Tokenizer that segments as the SentencePiece model does.

    Raises ValueError for model kinds (word, char) and settings (suffix marks, pieces
    defined by the user) that have no counterpart here.
    """
    if model.suffix_mark or not model.escape or model.kind not in (UNIGRAM, BPE) or any(k == USER for _, _, k in model.pieces):
        raise ValueError("this kind of model has no counterpart in the tokenizers library")
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, _merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=10_000)
    else:
        # Pieces that a text may not match get a score that keeps them off every best path.
        core = models.Unigram([(p, s if k in (NORMAL, UNKNOWN) else -1e6) for p, s, k in model.pieces], model.unknown, model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(f"[ {MARK}]{{2,}}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoder_of(model.dummy_prefix)
    return tokenizer


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file's bytes, read by the driver: a file or, with a scheme, a store that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as f:
            data = f.read()
    else:
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    if len(data) > MODEL_BYTES:
        raise ValueError(f"the model has {len(data)} bytes; at most {MODEL_BYTES} are sent to executors")
    return data


class Encoded(NamedTuple):
    """A text's ids as int32 bytes, and the text that they decode to."""

    ids: bytes
    text: str

    def __len__(self) -> int:
        return len(self.ids) // 4

    def tolist(self) -> list[int]:
        return np.frombuffer(self.ids, np.int32).tolist()


class BatchEncoder:
    """Ids of many texts at once, and their decoding, by the tokenizers library.

    Where no piece reaches over the start of a run of space marks, a text's ids are those of
    its words one after the other, and so is what they decode to. So the distinct words of
    a batch that are not known yet are encoded and decoded together, on the library's
    threads; their ids are kept as bytes, and of what they decode to only what differs from
    the word. Other models encode and decode whole texts. The words kept are bounded; past
    that they are forgotten and encoded anew.
    """

    KEPT = 200_000

    def __init__(self, model: SpModel):
        self.tokenizer = build_tokenizer(model)
        self.prefixed = model.dummy_prefix
        self.words = None
        if model.words_split and model.kind == BPE:
            self.line = "\n" if model.newline_alone and model.byte_fallback else ""
            self.words = re.compile(f"{MARK}*[^{MARK}{self.line}]+|{MARK}+" + (f"|{self.line}" if self.line else ""))
            self.bare = build_tokenizer(model)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([])
            self.bare.decoder = decoder_of(False)
            self.plain = model.dummy_prefix and not model.charsmap and not model.squeeze
            self.known: dict[str, bytes] = {"": b""}
            self.odd: dict[str, str] = {}
            self.opens = np.array([p.startswith(MARK) for p, _, _ in model.pieces])
            self.marked = any(p == MARK for p, _, _ in model.pieces)

    def _split(self, whole: str) -> list[str]:
        """The words of a normalised text; empty strings among them stand for nothing."""
        if MARK + MARK in whole:
            return self.words.findall(whole)
        apart = whole.replace(MARK, " " + MARK)
        return (apart.replace("\n", " \n ") if self.line else apart).split(" ")

    def _normalised(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.tokenizer.normalizer.normalize_str(text)

    def _learn(self, words: list[str]) -> None:
        """Encode and decode words in lines of a few dozen.

        A token that opens with the mark starts the next word, and a space what it decodes to.
        """
        lone = [w for w in words if self.marked and w[:1] == MARK and w[1:2] not in ("", MARK)]
        rest = list(set(words).difference(lone)) if len(lone) < len(words) else []
        parts = [lone[i : i + 50] for i in range(0, len(lone), 50)] + [[w] for w in rest]
        lines = list(map("".join, parts))
        found = [e.ids for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        first = len(parts) - len(rest)
        data = array("i", chain.from_iterable(found[:first])).tobytes()
        starts = (4 * np.flatnonzero(self.opens[np.frombuffer(data, np.int32)])).tolist()
        self.known.update(zip(lone, [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]))
        self.known.update(zip(rest, [array("i", ids).tobytes() for ids in found[first:]]))
        for part, line, text in zip(parts, lines, self.bare.decode_batch(found, skip_special_tokens=False)):
            if text != line.replace(MARK, " "):
                self._note(part, text)

    def _note(self, part: list[str], text: str) -> None:
        """Keep what each word of a line decodes to that is not the word itself."""
        heard = [text] if len(part) == 1 else [" " + t for t in text.split(" ")[1:]]
        if len(heard) != len(part):
            heard = self.bare.decode_batch([np.frombuffer(self.known[w], np.int32).tolist() for w in part], skip_special_tokens=False)
        self.odd.update((w, t) for w, t in zip(part, heard) if t != w.replace(MARK, " "))

    def _heard(self, whole: str, words: list[str]) -> str:
        """What the words' ids decode to."""
        text = whole.replace(MARK, " ") if not self.odd or self.odd.keys().isdisjoint(words) else "".join([self.odd.get(w, w.replace(MARK, " ")) for w in words])
        return text[1:] if self.prefixed and text[:1] == " " else text

    def __call__(self, texts: list[str]) -> list[Encoded]:
        if self.words is None:
            ids = [e.ids if t else [] for e, t in zip(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), texts)]
            return [Encoded(array("i", i).tobytes(), t) for i, t in zip(ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False))]
        if len(self.known) > self.KEPT:
            self.known, self.odd = {"": b""}, {}
        wholes = list(map(self._normalised, texts))
        split = list(map(self._split, wholes))
        if new := set().union(*split).difference(self.known):
            self._learn(list(new))
        known = self.known.__getitem__
        return [Encoded(b"".join(map(known, words)), self._heard(whole, words)) for whole, words in zip(wholes, split)]


_ready: dict[int, tuple] = {}


def _tools(data: bytes) -> tuple:
    """(encoder, SentencePiece) of a model, built once in each worker."""
    key = hash(data)
    if key not in _ready:
        _ready[key] = BatchEncoder(SpModel(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    return _ready[key]


def encode_texts(docs: DataFrame, model: str, text_col: str = "text", threads: int = 2, verify: bool = True, added: tuple[str, ...] = ("token_ids", "n_tokens", "parity", "round_trip")) -> DataFrame:
    """docs with four columns: token_ids array<int>, n_tokens long, parity and round_trip boolean.

    The model file is parsed and rebuilt for the tokenizers library, which encodes and
    decodes on `threads` threads. parity: SentencePiece itself gives the same ids for this
    whole text (null unless verify). round_trip: decoding the ids gives the text back; false
    where the model's normaliser changes it, as for texts that hold the space mark itself.
    Null and empty texts have no tokens and round-trip to an empty text. Equal texts of an
    Arrow batch are encoded, checked and decoded once. docs' columns of the names in `added`
    are replaced. An empty table gives no rows.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_model(docs.sparkSession, model))  # at most MODEL_BYTES
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(*(f"`{c}`" for c in kept))
    at = kept.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        encode, pieces = _tools(data.value)
        texts = [t or "" for t in batch.column(at).to_pylist()]
        found: dict[str, tuple[bytes, bool | None, bool]] = {}
        for part in _portions(list(dict.fromkeys(texts))):
            own = encode(part)
            same = [array("i", theirs).tobytes() == e.ids for e, theirs in zip(own, pieces.encode(part, num_threads=threads))] if verify else [None] * len(part)
            found.update((t, (e.ids, p, e.text == t)) for t, e, p in zip(part, own, same))
        done = [found[t] for t in texts]
        sizes = np.array([len(d[0]) // 4 for d in done], np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join([d[0] for d in done]), np.int32))
        lists = pa.ListArray.from_arrays(pa.array(ends), values)
        return pa.record_batch([*batch.columns, lists, pa.array(sizes), *(pa.array([d[i] for d in done], pa.bool_()) for i in (1, 2))], names=[f"c{i}" for i in range(len(kept) + 4)])

    out = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema)), *(f"c{len(kept) + i} {kind}" for i, kind in enumerate(("array<int>", "long", "boolean", "boolean")))])
    return by_batch(rows, run, out).toDF(*kept, *added)


def _portions(texts: list[str], characters: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in lists of about so many characters, so that encodings don't pile up."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= characters:
            yield part
            part, size = [], 0
    if part:
        yield part
