"""SentencePiece encoding and decoding over a given vocabulary file.

An Aho-Corasick automaton over the pieces reads a chunk once; every match that its output links give relaxes the
best score at the match's end. Characters without a piece of their own fall back to byte pieces. Of equal scores
the longer last piece wins.

Scores are those of the file. A leading space is added, spaces become U+2581, and a literal U+2581 is written as
byte pieces, so decoding gives the text back exactly. Where no piece holds U+2581 behind another character, the
best path never crosses the start of a run of U+2581, so chunks between are scored apart and remembered.
Null texts have null ids and decode to null; empty texts have no ids.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
FALLBACK_PENALTY = 10.0
NEVER = -1e8
"""Pieces at or below this score are spelled out by design of the file; they do not set the fallback."""
MEMO_CHUNKS, MEMO_CHARS = 200_000, 64
DECODE_ROWS = 1000


def load(path: str = MODEL) -> dict:
    """Pieces and scores of a model file; its size bounds what is sent to executors."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError(f"{path} has no byte pieces")
    usable = {
        i: (sp.id_to_piece(i), sp.get_score(i)) for i in range(n) if not (
            sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        ) and sp.id_to_piece(i)
    }
    return {"usable": usable, "bytes": [byte_ids[b] for b in range(256)]}


class Encoder:
    def __init__(self, model: dict) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in model["usable"].items():
            self.automaton.add_word(piece, (i.to_bytes(4, "little"), len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in model["usable"].values() if len(p) == 1}
        self.byte_ids = model["bytes"]
        self.fallback = min(s for _, s in model["usable"].values() if s > NEVER) - FALLBACK_PENALTY
        whole = any(SPACE in p.lstrip(SPACE) for p, _ in model["usable"].values())
        self.chunks = re.compile("(?s).+" if whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo_ids: dict[str, bytes] = {}
        self.memo_scores: dict[str, float] = {}
        self.pieces = {i: p for i, (p, _) in model["usable"].items()}
        self.literal = b"".join(self._byte_piece(SPACE))

    def _byte_piece(self, text: str) -> list[bytes]:
        return [self.byte_ids[b].to_bytes(4, "little") for b in text.encode("utf-8", "surrogatepass")]

    def viterbi(self, chunk: str) -> tuple[bytes, float]:
        """Ids (four bytes each) and score of the best path."""
        n = len(chunk)
        none = float("-inf")
        best = [0.0] + [none] * n
        back: list[tuple[int, bytes]] = [(0, b"")] * (n + 1)
        single, fallback = self.single, self.fallback
        at = 0  # positions up to here have their final score
        for end, (i, size, score) in self.automaton.iter(chunk):
            while at < end:  # characters without a piece of their own fall back to bytes
                if chunk[at] not in single and best[at] + fallback > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + fallback, (at, b"")
                at += 1
            start = end + 1 - size
            score += best[start]
            if score > best[end + 1] or (score == best[end + 1] and start < back[end + 1][0]):
                best[end + 1], back[end + 1] = score, (start, i)
        while at < n:
            if chunk[at] not in single and best[at] + fallback > best[at + 1]:
                best[at + 1], back[at + 1] = best[at] + fallback, (at, b"")
            at += 1
        ids: list[bytes] = []
        end = n
        while end:
            start, i = back[end]
            if i:
                ids.append(i)
            else:
                ids += self._byte_piece(chunk[start:end])[::-1]
            end = start
        return b"".join(reversed(ids)), best[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        ids, scores = self.memo_ids, self.memo_scores
        if len(ids) > MEMO_CHUNKS:
            ids.clear()
            scores.clear()
        out: list[bytes] = []
        total = 0.0
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(self.literal)
                total += 3 * self.fallback
            chunks = self.chunks.findall((SPACE if k == 0 and text else "") + part.replace(" ", SPACE))
            for c in chunks:
                if c not in ids:
                    ids[c], scores[c] = self.viterbi(c)
            out += map(ids.__getitem__, chunks)
            total += sum(map(scores.__getitem__, chunks))
            for c in [c for c in chunks if len(c) > MEMO_CHARS]:
                ids.pop(c, None), scores.pop(c, None)
        return b"".join(out), total


class Decoder:
    def __init__(self, model: dict) -> None:
        of = {i: p.replace(SPACE, " ").encode() for i, (p, _) in model["usable"].items()}
        of |= {i: bytes([b]) for b, i in enumerate(model["bytes"])}
        self.of = pa.array([of.get(i, b"") for i in range(max(of) + 1)], pa.binary())

    def decode(self, ids: pa.ListArray) -> list[bytes | None]:
        """The texts of a column of ids: all pieces are gathered into one buffer, which the rows then share out."""
        starts = np.asarray(ids.offsets)
        first, starts = starts[0], starts - starts[0]  # ids may be a slice
        flat = self.of.take(ids.values.slice(first, starts[-1]))
        ends = np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset :][starts].tolist()
        data = memoryview(flat.buffers()[2] or b"")
        return [data[a + 1 : b].tobytes() if ok else None for a, b, ok in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)]


def _ids_array(found: list, valid: list[bool]) -> pa.ListArray:
    sizes = np.array([len(x) // 4 for x in found], dtype=np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([not v for v in valid] + [False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), dtype=np.int32)))


def encode(df: DataFrame, model: dict, text: str = "text", ids: str = "piece_ids", score: str = "piece_score", check: str | None = None) -> DataFrame:
    """df with the columns ids (array of int) and score at the end, and with check a column of that name: whether the ids
    decode to the text (null to null). Where df has such a name, theirs end in underscores. Equal texts get equal ids."""
    ids, score, *checked = common.free_names(df, ids, score, *([check] if check else []))
    own = common.with_last(df, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in batches:
            for at, n in common.row_groups(batch.column(batch.num_columns - 1)):
                rows = batch.slice(at, n)
                given = rows.column(rows.num_columns - 1).to_pylist()
                found = [encoder.encode(t) if t is not None else (b"", None) for t in given]
                coded = _ids_array([f[0] for f in found], [t is not None for t in given])
                arrays = [*rows.columns, coded, pa.array([f[1] for f in found], pa.float64())]
                if checked:
                    back = decoder.decode(coded)
                    same = [x == (None if t is None else t.encode()) for x, t in zip(back, given, strict=True)]
                    arrays.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*rows.schema.names, ids, score, *checked])

    kinds = [f"`{ids}` array<int>", f"`{score}` double", *(f"`{c}` boolean" for c in checked)]
    made = common.map_batches(own, run, ", ".join([common.ddl(own), *kinds]))
    return common.as_before(made, df, ids, score, *checked)


def decode(df: DataFrame, model: dict, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """df with the column text, put together from the ids, at the end; where df has such a name, its name ends in underscores."""
    (text,) = common.free_names(df, text)
    own = common.with_last(df, ids)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                rows = batch.slice(at, DECODE_ROWS)
                texts = decoder.decode(rows.column(rows.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*rows.schema.names, text])

    return common.as_before(common.map_batches(own, run, f"{common.ddl(own)}, `{text}` string"), df, text)


def op7(spark, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, score, digest of the ids, and of what they decode to."""
    model = load()
    found = decode(encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return found.select(
        "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), F.col("piece_score").alias("score"),
        F.xxhash64("piece_ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )
