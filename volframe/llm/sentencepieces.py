"""SentencePiece encoding with source spans, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import read
from .tokenizing import ChunkStore, groups, shared, split_chunks, sums, texts_of, tokenizer_file

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


class CharacterMap:
    """A compiled character map: a double-array trie of source byte strings and what each is replaced by.

    blob: 4 bytes with the trie's size, the trie's 32-bit units, then the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]
        self.found: dict[bytes, tuple[int, bytes]] = {}

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes of the longest key that text has at `at`, where its replacement begins); 0 bytes if there is none."""
        units, best = self.units, (0, 0)
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        return best

    def apply(self, text: bytes) -> tuple[bytes, list[int]]:
        """The normalised bytes and, for each of them, the byte of the source it comes from; then the source's length."""
        out, source, at = bytearray(), [], 0
        while at < len(text):
            n, start = self.longest(text, at) if self.units else (0, 0)
            if n:
                new = self.replacements[start : self.replacements.index(b"\0", start)]
            else:
                first = text[at]
                n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = text[at : at + n]
            out += new
            source += [at] * len(new) if new != text[at : at + n] else range(at, at + n)
            at += n
        return bytes(out), [*source, len(text)]


class PieceEncoder:
    """Ids and source byte spans of whole texts by a SentencePiece BPE model, as the library gives them.

    A text goes through the character map by longest prefix, recording the source byte of every normalised byte; then
    blanks are trimmed or marked as the model's settings say; then the library's BPE, with normalisation turned off,
    cuts it into pieces, whose lengths, added up, are projected through the record to spans of the source's bytes.
    Where no piece has a blank after another character, BPE never joins across blanks, and chunks are encoded apart.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.mark = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.bos, self.eos, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        pieces = [p.piece for p in proto.pieces]
        self.apart = self.mark and not any(SPACE in p.lstrip(SPACE) for p in pieces) and not any(p.type == 4 for p in proto.pieces)
        self.widths = [1 if BYTE.match(p) else len(p.encode()) for p in pieces]
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.apart else re.compile(r"(?s).+")
        self.store = ChunkStore(self._learn, (np.uint32, np.int32))

    def _learn(self, chunks: list[str]) -> list[tuple]:
        found = []
        for chunk, ids in zip(chunks, self.bare.encode(chunks, num_threads=1), strict=True):
            if self.unknown in ids:
                pieces = self.bare.encode(chunk, return_type="proto").pieces
                found.append((ids, [len(p.surface.encode()) for p in pieces]))
            else:
                found.append((ids, [self.widths[i] for i in ids]))
        return found

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and the source byte of each of its bytes and of its end. Without a character map and
        trimming, the record is None: bytes keep their order, and only marks and the prefix have other lengths."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.trim and self.mark:
            return (SPACE if self.prefix else "") + text.replace(" ", SPACE), None
        norm, source = self.map.apply(text.encode("utf-8", "surrogatepass"))
        out, at, last_blank = bytearray(), [], True
        if self.trim:
            end = len(norm.rstrip(b" "))
            for i in range(end):
                blank = norm[i] == 32
                if not (blank and last_blank):
                    out.append(norm[i])
                    at.append(source[i])
                last_blank = blank
            at.append(source[end])
        else:
            out, at = bytearray(norm), source
        if self.prefix and out:
            out, at = b" " + bytes(out), [at[0], *at]
        if self.mark:
            widths = np.where(np.frombuffer(bytes(out), np.uint8) == 32, 3, 1)
            at = [*np.repeat(at[:-1], widths), at[-1]]
            out = bytes(out).replace(b" ", SPACE.encode())
        return bytes(out).decode("utf-8", "replace"), np.array(at, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of ids of each text, ids, first source byte, source byte after the last) of all texts on end, without
        begin and end ids."""
        normal, records = zip(*map(self.normalise, texts), strict=True) if texts else ((), ())
        chunks, counts = split_chunks(list(normal), self.chunks)
        lengths, (ids, widths) = self.store.gather(self.store.rows(chunks))
        n = sums(lengths, counts)
        ends = np.cumsum(widths, dtype=np.int64)
        per_text = sums(widths.astype(np.int64), n)
        base = np.repeat(np.cumsum(per_text) - per_text, n)
        first, after = ends - widths - base, ends - base
        spans = [np.zeros_like(first), np.zeros_like(after)]
        at = 0
        for text, record, k in zip(texts, records, n, strict=True):
            if record is None:
                record = self._plain_record(text)
            for whole, span in zip((first, after), spans, strict=True):
                span[at : at + k] = record[whole[at : at + k]]
            at += k
        return n, ids, spans[0], spans[1]

    def _plain_record(self, text: str) -> np.ndarray:
        """The record of a text whose blanks alone change: each of a mark's three bytes comes from its blank."""
        raw = np.frombuffer(text.encode(), np.uint8)
        source = np.repeat(np.arange(len(raw)), np.where(raw == 32, 3, 1))
        return np.concatenate([np.zeros(3 * self.prefix, np.int64), source, [len(raw)]])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = shared(PieceEncoder, path)
    for batch in batches:
        texts, keys = texts_of(batch), batch.column(0)
        for start, run in groups(texts):
            n, ids, first, after = encoder.encode(run)
            out = {"n_tokens": n + 2, "ids_sha256": [], "decoded_sha256": [], "covered_bytes": sums((after - first).astype(np.int64), n)}
            full, at = [], 0
            for k in n:
                own = np.concatenate([[encoder.bos], ids[at : at + k], [encoder.eos]]).astype("<u4")
                out["ids_sha256"].append(hashlib.sha256(own.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(encoder.decode(own.tolist()).encode()).hexdigest())
                full.append((own, first[at : at + k], after[at : at + k]))
                at += k
            columns = [keys.slice(start, len(run)), *(pa.array(v) for v in out.values())]
            names = ["_key", *out]
            if with_ids:
                columns += [pa.array([x[i] for x in full], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())))]
                names += ["ids", "first_bytes", "after_bytes"]
            yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, key: str, text: str, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and covered_bytes of every row of docs, with begin and end ids; and,
    with_ids, the ids themselves and each piece's source bytes from first_bytes to before after_bytes.

    A null text is an empty one: begin and end ids alone. covered_bytes adds the pieces' spans: a character that the
    model knows only as bytes gives each byte its own span. model: path of a SentencePiece model on every machine.
    One pass over the rows without a shuffle; a Python worker keeps a bounded store of chunks.
    """
    path = model or tokenizer_file(MODEL)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long"
    if with_ids:
        schema += ", ids array<long>, first_bytes array<long>, after_bytes array<long>"
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _encoded(it, path, with_ids), schema).withColumnRenamed("_key", key)


def op1(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", with_ids=False)
