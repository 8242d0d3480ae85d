"""Operator 2, SentencePiece encoding and decoding with the tokenizers library, rebuilt from the model's protobuf and held against sentencepiece."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import named, numbered, release, slices

#: The default model; any SentencePiece unigram or BPE model will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The white space marker of SentencePiece. Fixed value.
MARK = "▁"
#: Piece and model types of the protobuf. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message: ints, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            x = b[at]
            at += 1
            out |= (x & 127) << shift
            shift += 7
            if x < 128:
                return out

    while at < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, b[at : at + n]
            at += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        out = cls([])
        for k, v in _fields(raw):
            if k == 1:
                p = dict(_fields(v))
                out.pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), p.get(3, NORMAL)))
            elif k == 2:
                t = dict(_fields(v))
                out.kind, out.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
            elif k == 3:
                t = dict(_fields(v))
                out.charsmap, out.dummy_prefix, out.squeeze, out.escape = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1)), bool(t.get(5, 1))
        return out

    @property
    def words_part(self) -> bool:
        """Whether no piece has a marker after another character, so that no merge crosses the start of a marked run."""
        return self.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in self.pieces)


def build(model: Model):
    """A tokenizers.Tokenizer with the model's normaliser, marker, scores or merges, byte fallback and decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        # a merge makes the piece of the best score: a piece's merges have its place in the order of scores
        merges = []
        for p, s, t in model.pieces:
            if t == NORMAL and len(p) > 1:
                own = [(ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
                merges += [(-s, ids[p], a, b, left, right) for a, b, left, right in own]
        merges.sort(key=lambda m: m[:4])
        core = models.BPE(ids, [m[4:] for m in merges], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if model.words_part:
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    last = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    return out


_made: dict = {}


def tokenizer(raw: bytes):
    """One for each model in a Python worker, with its byte pieces and whether it parts words."""
    key = hash(raw)
    if key not in _made:
        model = Model.parse(raw)
        _made[key] = (model, build(model))
    return _made[key]


#: What units are parted by on the way; texts that have it are parted one by one. Units in a run, and runs that the libraries take at once.
SEP, RUN, RUNS = "\x1f", 64, 512
#: Units that a coder keeps from batch to batch; beyond, it starts anew.
KEPT = 1_000_000


class Coder:
    """Encodes batches of texts by units, each distinct unit of its batches once (up to KEPT of them): encoded, decoded by the library's decoder and held against sentencepiece.

    A unit is a run of spaces with the word after it, or a line end. Both are proved on the vocabulary: no piece has a marker after another character, and
    no piece but a byte has a line end, so no merge crosses the border of units. So runs of units, parted by line ends, go through both libraries
    at once; a run that either does not give back is tried unit by unit. Where the vocabulary or the normaliser does not allow that, and for
    texts with a literal marker, whole texts are encoded, decoded and compared.

    judged: whether units are decoded and held against sentencepiece. Where they are not, every text is, whole, so no check is made twice.
    """

    def __init__(self, raw: bytes, judged: bool = True):
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        self.model, self.tok = tokenizer(raw)
        m = self.model
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
        end = [i for i, (p, _, t) in enumerate(m.pieces) if t == BYTE and p == "<0x0A>"]
        self.by_units = m.words_part and not m.charsmap and not m.squeeze and m.byte_fallback and bool(end) and not any("\n" in p for p, _, _ in m.pieces)
        self.end = end[0] if end else -1
        self.kept, self.judged = None, judged
        # units are given as normalised text and keep their space
        self.plain, self.back = Tokenizer(self.tok.model), Tokenizer(self.tok.model)
        steps = [decoders.ByteFallback(), decoders.Fuse()]
        # where the marker is a piece, no text's byte pieces spell it, so it can be replaced once a text, not once a piece
        steps.insert(2 if self.tok.token_to_id(MARK) is not None else 0, decoders.Replace(MARK, " "))
        self.plain.decoder = decoders.Sequence(steps)
        self.back.decoder = decoders.Sequence([*steps, *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        self.split = re.compile(" +[^ \n]*|\n|[^ \n]+").findall
        self.head = len(self.judge.encode("\n")) if m.dummy_prefix else 0  # sentencepiece puts a space before a text, so it is asked behind a line end

    def recall(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, and by unit: where its own start, their number, whether it decodes to itself, whether sentencepiece agrees) of distinct units; new ones are learned."""
        if self.kept is None or len(self.kept[0]) + len(units) > KEPT:
            none, no = np.zeros(0, np.int32), np.zeros(0, bool)
            self.kept = (units[:0], none, none, none, no, no)
        old, ids, *by_unit = self.kept
        found = pc.index_in(units, value_set=old)
        new = found.is_null()
        learned, size, ok, same = self.learn(units.filter(new))
        starts = (len(ids) + np.cumsum(size) - size).astype(np.int32)
        by_unit = [np.concatenate(x) for x in zip(by_unit, (starts, size.astype(np.int32), ok, same), strict=True)]
        self.kept = (pa.concat_arrays([old, units.filter(new)]), np.concatenate((ids, learned)), *by_unit)
        slot, new = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), new.to_numpy(zero_copy_only=False)
        slot[new] = len(old) + np.arange(int(new.sum()))
        return self.kept[1], *(x[slot] for x in by_unit)

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number by unit, whether it decodes to itself, whether sentencepiece has the same ids) of distinct units; the last two are false where they are not judged."""
        runs = np.append(np.arange(0, len(units), RUN, dtype=np.int32), np.int32(len(units)))
        own = pc.if_else(pc.equal(units, "\n"), "", units)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(runs), own), "\n")
        ids, ok, same = [], np.full(len(units), self.judged), np.full(len(units), self.judged)
        front = "\n" if self.head else ""
        for a in range(0, len(texts), RUNS):  # the libraries' results are large
            part = texts.slice(a, RUNS).to_pylist()
            found = [e.ids for e in self.plain.encode_batch_fast([t.replace(" ", MARK) for t in part], add_special_tokens=False)]
            back, judged = part, found
            if self.judged:
                back = self.plain.decode_batch(found, skip_special_tokens=False)
                judged = [j[self.head :] for j in self.judge.encode([front + t for t in part], num_threads=1)]
            for r, (t, x, b, j) in enumerate(zip(part, found, back, judged, strict=True)):
                if not (b == t and j == x and x.count(self.end) == runs[a + r + 1] - runs[a + r] - 1):
                    at = slice(int(runs[a + r]), int(runs[a + r + 1]))
                    x, ok[at], same[at] = self.one_by_one(own[at].to_pylist(), front)
                ids.append(np.array([*x, self.end], np.int32))
        ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        ends = np.flatnonzero(ids == self.end)
        size = np.diff(ends, prepend=-1) - 1
        line = pc.index(units, "\n").as_py()
        if line >= 0:  # its ids are the parting end itself
            size[line] = 1
            keep = np.ones(len(ids), bool)
            keep[ends] = False
            keep[ends[line]] = True
            return ids[keep], size, ok, same
        return ids[ids != self.end], size, ok, same

    def one_by_one(self, units: list[str], front: str) -> tuple[list[int], list[bool], list[bool]]:
        """A run whose units are encoded, decoded and compared each on its own: (ids parted by line ends, which decode, which agree)."""
        found = [e.ids for e in self.plain.encode_batch([u.replace(" ", MARK) for u in units], add_special_tokens=False)]
        ok = [b == u for b, u in zip(self.plain.decode_batch(found, skip_special_tokens=False), units, strict=True)]
        same = [j[self.head :] == x and self.end not in x for j, x in zip(self.judge.encode([front + u for u in units], num_threads=1), found, strict=True)]
        return [i for x in found for i in (*(y for y in x if y != self.end), self.end)][:-1], ok, same

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(units of all texts one after the other, number by text), by the library of Arrow where no text needs more."""
        front = " " if self.model.dummy_prefix else ""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, SEP))
        if front:  # makes a run with a text's own first space
            odd = pc.or_(odd, pc.starts_with(texts, front))
        easy = pc.if_else(odd, "", texts)
        if front:
            easy = pc.if_else(pc.equal(easy, ""), "", pc.binary_join_element_wise(front, easy, ""))
        easy = pc.replace_substring(easy, "\n", f"{SEP}\n{SEP}")
        parts = pc.split_pattern(pc.replace_substring(easy, " ", f"{SEP} "), SEP)
        flat, n = parts.flatten(), pc.list_value_length(parts).to_numpy().astype(np.int64)
        there = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if not len(there):
            return flat, n
        own = [self.split(front + texts[int(i)].as_py()) for i in there]
        at, pieces_, last = np.concatenate(([0], np.cumsum(n))), [], 0
        for i, u in zip(there.tolist(), own, strict=True):
            pieces_ += [flat.slice(at[last], at[i] - at[last]), pa.array(u, flat.type)]
            n[i], last = len(u), i + 1
        return pa.concat_arrays([*pieces_, flat.slice(at[last])]), n

    def encode(self, texts: pa.Array, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts that are not null: (all ids, number by text, whether it decodes to itself, whether sentencepiece has the same ids).

        asked: texts that sentencepiece is given whole besides.
        """
        whole = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) if self.by_units else np.ones(len(texts), bool)
        flat, n = self.units(pc.if_else(pa.array(whole), "", texts))
        flat = flat.dictionary_encode()
        known, starts, size, decodes, agrees = self.recall(flat.dictionary)
        slot, row = flat.indices.to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), n)
        number = size[slot]
        at = np.repeat(starts[slot] - (np.cumsum(number, dtype=np.int32) - number), number)
        at += np.arange(len(at), dtype=np.int32)
        ids = known[at]
        number = np.bincount(row, number, len(n)).astype(np.int64)
        every = lambda good: np.bincount(row, ~good[slot], len(n)) == 0
        ok, same = (np.ones(len(n), bool), np.ones(len(n), bool)) if decodes.all() and agrees.all() else (every(decodes), every(agrees))
        again = whole | ~ok | ~same | (False if asked is None else asked)
        if again.any():
            ends = np.cumsum(number)
            parts = [ids[b - n : b] for b, n in zip(ends.tolist(), number.tolist(), strict=True)]
            for i, e in zip(np.flatnonzero(whole).tolist(), self.tok.encode_batch(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, np.int32)
            for i in np.flatnonzero(again).tolist():  # one by one, as lists of ids are ten times as large
                t = texts[i].as_py()
                ok[i] = self.back.decode(parts[i].tolist(), skip_special_tokens=False) == t
                same[i] = np.array_equal(parts[i], self.judge.encode(t, return_type="numpy"))
            if whole.any():
                ids, number = np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts], np.int64)
        return ids, number, ok, same


def encode(docs: DataFrame, model: str = MODEL, threads: int = 2, check_every: int = 16) -> DataFrame:
    """docs plus ids (array of int), n_pieces, decoded_ok (whether the library's decoder gives the text back) and parity (whether sentencepiece gives the same ids).

    The model file is read once by the driver and sent along; its size is that of a vocabulary. Whole texts, in slices of bounded size, no special
    pieces added. Both checks hold for every text: unit by unit (see Coder), and over the whole text for those whose xxhash64 is divisible by
    check_every, those with a unit that fails and those that are not parted. A check_every of 1 checks every text whole, and units not besides.
    Null texts: all four null. Empty texts: no ids, true. Repeated rows stay, an empty table stays empty; other columns are kept, whatever their names; the four replace columns of these names.
    decoded_ok is false where a model's normaliser changes the text or the text has a literal marker.
    """
    from pyspark.sql import types as T

    raw = open(model, "rb").read()
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "n_pieces", "decoded_ok", "parity")]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("decoded_ok", T.BooleanType()), T.StructField("parity", T.BooleanType())])
    x, at = numbered(docs)
    marked = x.select(*[at[f.name] for f in kept], F.col(at["text"]).alias("text"), F.coalesce(F.pmod(F.xxhash64(at["text"]), F.lit(check_every)) == 0, F.lit(False)).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        coder = Coder(raw, judged=check_every != 1)
        for whole in batches:
            for b in slices(whole, "text", 8192, 1 << 23):
                texts = b.column("text")
                there = texts.is_valid().to_numpy(zero_copy_only=False)
                ids, n, ok, same = coder.encode(texts.filter(pa.array(there)).cast(pa.string()), b.column("asked").to_numpy(zero_copy_only=False)[there])
                number = np.zeros(len(b), np.int64)
                number[there] = n
                offsets = np.concatenate(([0], np.cumsum(number))).astype(np.int32)
                put = lambda v: pa.array(np.where(there, v, 0) if v.dtype != bool else v, mask=~there)
                full_ok, full_same = np.zeros(len(b), bool), np.zeros(len(b), bool)
                full_ok[there], full_same[there] = ok, same
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=pa.array(~there)), put(number), put(full_ok), put(full_same)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(schema.names) - 4], *more], names=schema.names)
            release()

    return marked.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows plus decoded, the text of ids, by the tokenizers library's own decoder, multithreaded. Null ids: null; no ids: empty. Other columns are kept."""
    raw = open(model, "rb").read()

    @F.pandas_udf("string")
    def back(ids: pd.Series) -> pd.Series:
        _, tok = tokenizer(raw)
        there = ids.notna()
        texts = tok.decode_batch([list(map(int, x)) for x in ids[there]], skip_special_tokens=False)
        return pd.Series(texts, ids.index[there], dtype=object).reindex(ids.index)

    x, at = numbered(rows)
    return named(x, at, decoded=back(at["ids"]))
