"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

A rank file lists every token's bytes with its merge rank. The model is built from it in memory: each byte b is
written as the character with its number (byte 0 as U+0100), each token is one piece scored by its negative rank, normalisation is the
identity. sentencepiece then merges, within one pre-token, the adjacent pair with the best score, leftmost first,
which is the order in which ranks merge. A pre-token that is itself a token is that token.

A boundary between a non-space character and a following space always ends a pre-token, whatever follows. Texts are
therefore cut there first and whole units are looked up in a bounded per-task cache; only units not seen before are
split by the pattern and encoded. The result doesn't depend on the cache.
"""

from __future__ import annotations

import base64
import re
import sys
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batches, small_batches

assert array("I").itemsize == 4 and sys.byteorder == "little"

#: Units kept per process. Beyond it only those of the texts in work stay, which costs time and changes no result.
CACHE_UNITS = 250_000
#: Longer units are encoded without being kept.
CACHE_UNIT_CHARS = 64

_CUT = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"\s ")

#: Ids that are decoded at once.
DECODED_IDS = 1 << 16
#: Characters of the texts that are cut into units at once; a longer text is taken in pieces of about this size.
GROUP_CHARS = 1 << 20


def _split(text: str) -> list[str]:
    return text.split(" ")


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """The text in pieces that end before a space after a character that is none, and whether each is the last."""
    at = 0
    while len(text) - at > GROUP_CHARS:
        cut = text.find(" ", at + GROUP_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut], False
        at = cut
    yield text[at:] if at else text, True


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines `base64 rank` of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model for these ranks; ranks must be 0..n-1 and hold all single bytes."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and cover all bytes")
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=token.decode("latin-1").replace("\0", "\u0100"), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size, spec.unk_piece = pb.TrainerSpec.BPE, len(tokens) + 1, "<unk>"
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces = "identity", False, False, False
    return model.SerializeToString()


class ByteBpe:
    """Encoder and decoder over one rank table; make one per process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes | None = None):
        import regex
        from sentencepiece import SentencePieceProcessor

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.model = SentencePieceProcessor(model_proto=model or model_bytes(ranks))
        self.pieces = sorted(ranks, key=ranks.get)
        self.whole = {}
        for token, rank in ranks.items():
            try:
                self.whole[token.decode()] = array("I", [rank]).tobytes()
            except UnicodeDecodeError:  # part of a character: never a pre-token of its own
                pass
        own_token = [m for m in ".,;:!?" if self.split(f" a{m}") == [" a", m] and self.split(" a") == [" a"]]
        self.marks = {m: self._encode_tokens([m])[0] for m in own_token}
        self.cache: dict[str, bytes] = {}

    def _encode_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens."""
        whole = self.whole
        todo = [p for p in tokens if p not in whole]
        mapped = [p if p.isascii() and "\0" not in p else p.encode().decode("latin-1").replace("\0", "\u0100") for p in todo]
        found = iter(self.model.encode(mapped, num_threads=1) if todo else ())
        return [whole[p] if p in whole else array("I", next(found)).tobytes() for p in tokens]

    def _learn(self, new: set[str]) -> None:
        """Put units (without their leading space) into the cache."""
        cache, split = self.cache, self.split
        words = [u for u in new if u.isalpha()]  # only letters: with its space, one pre-token
        other = [u for u in new if not u.isalpha()]
        marked = [u for u in other if u[-1:] in self.marks and u[:-1].isalpha()]  # a word and a mark: two
        words = list({*words, *(u[:-1] for u in marked)}.difference(cache))
        cache.update(zip(words, self._encode_tokens([" " + u for u in words])))
        marks = self.marks
        for u in marked:
            cache[u] = cache[u[:-1]] + marks[u[-1]]
        other = [u for u in other if u not in cache]
        parts = [split(" " + u) for u in other]
        tokens = list({p for own in parts for p in own})
        found = dict(zip(tokens, self._encode_tokens(tokens)))
        for u, own in zip(other, parts):
            cache[u] = b"".join([found[p] for p in own])

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; some 256 texts or GROUP_CHARS are in work at once."""
        group, chars, done = [], 0, []
        for text in texts:
            for piece in _pieces(text):
                group.append(piece)
                chars += len(piece[0])
                if len(group) >= 256 or chars >= GROUP_CHARS:
                    yield from self._joined(group, done)
                    group, chars = [], 0
        yield from self._joined(group, done)

    def _joined(self, group: list[tuple[str, bool]], done: list[bytes]) -> Iterator[bytes]:
        """Whole texts' ids; done holds those of the pieces before of a text that goes on."""
        for (_, last), ids in zip(group, self._encode_pieces([piece for piece, _ in group])):
            done.append(ids)
            if last:
                yield b"".join(done)
                done.clear()

    def _encode_pieces(self, texts: list[str]) -> Iterator[bytes]:
        cache = self.cache  # a unit's text after its leading space -> ids with that space
        cut = [(_CUT.split if _ODD.search(text) else _split)(text) for text in texts]
        first = [self.split(units[0]) for units in cut]
        tokens = list({p for own in first for p in own})
        found = dict(zip(tokens, self._encode_tokens(tokens)))
        heads = [b"".join([found[p] for p in own]) for own in first]
        for units in cut:
            del units[0]
        here = set().union(*cut)
        new = here.difference(cache)
        if len(cache) + len(new) > CACHE_UNITS:  # what these texts use is kept: it holds the frequent units
            kept = {u: cache[u] for u in here.difference(new)}
            cache.clear()
            cache.update(kept)
        self._learn(new)
        get = cache.__getitem__
        for head, units in zip(heads, cut):
            yield head + b"".join(map(get, units))
        for u in new:
            if len(u) > CACHE_UNIT_CHARS:
                del cache[u]
                cache.pop(u[:-1], None)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_batch([text])), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """Bytes of the ids; an id outside the vocabulary is an error."""
        all_ids, get = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, "<u4"), self.pieces.__getitem__
        return b"".join([b"".join(map(get, all_ids[at : at + DECODED_IDS].tolist())) for at in range(0, len(all_ids), DECODED_IDS)])


#: The encoder that this worker process built last; its cache serves all tasks of the process.
_BUILT: dict[str, ByteBpe] = {}


class Tokenizer:
    """A rank file and pattern on the way to the tasks: broadcast once (the vocabulary bounds its size)."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = read_ranks(f.read())
        self.n = len(ranks)
        self.pattern = pattern
        self.sent = spark.sparkContext.broadcast((ranks, model_bytes(ranks)))

    def maker(self):
        """A function for tasks that makes a ByteBpe; it holds the broadcast and the pattern, never the session."""
        sent, pattern, key = self.sent, self.pattern, uuid.uuid4().hex

        def make() -> ByteBpe:
            if key not in _BUILT:
                ranks, model = sent.value
                _BUILT.clear()
                _BUILT[key] = ByteBpe(ranks, pattern, model)
            return _BUILT[key]

        return make


def encode_decode(docs: DataFrame, tokenizer: Tokenizer, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per input row: id_col, ids (binary, little-endian unsigned 32-bit), decoded (binary, if decode).

    No shuffle: each task streams its own rows. A null text counts as empty and gives no ids; null and repeated ids
    are kept as they are; other columns are not read, whatever they are called; an empty table gives no rows. Texts are
    encoded whole, whatever their length. From here on the session sends rows to Python in smaller batches (small_batches).
    """
    make = tokenizer.maker()
    source = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(id_col, to_arrow_type(kind)), ("ids", pa.binary()), *[("decoded", pa.binary())] * decode])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()

        def rows():
            for batch in stream:
                keys = batch.column(0).to_pylist()
                for key, ids in zip(keys, bpe.encode_batch(batch.column(1).to_pylist())):
                    yield (key, ids, bpe.decode(ids)) if decode else (key, ids)

        return batches(rows(), schema, lambda r: 16 + 2 * len(r[1]))

    return source.mapInArrow(run, f"{id_col} {kind.simpleString()}, ids binary" + ", decoded binary" * decode)
