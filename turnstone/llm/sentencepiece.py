"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has white-space markers after another character, so no piece and no merge crosses the place where a
marker follows another character. Each text is cut there; each distinct marked word is segmented once into the table of
its task, and ids are joined back by position. (One table for the corpus would be a departure the other way: every position of every
text would be shuffled to its word and back, some ten times the input; a table for each task segments common words once a task
and moves nothing.) The table is emptied at `table_size` chunks or `table_chars` characters to bound memory, and chunks of more than `long_chunk`
characters are not kept in it; what is not kept is segmented again, so results don't depend on it. `check_model` refuses models for which the cut isn't exact.

Defined results: a null text is empty; an empty text has the begin and end ids alone; texts of any length are whole;
repeated rows have equal results; an empty table gives no rows; other columns are kept as they are unless they have a
result's name (the input's column then goes).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
MODEL = "piece_bpe_32k.model"


def check_model(model) -> None:
    crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if re.search(f"[^{MARK}]{MARK}", p)]
    probe = "a  B ﬁ\n\tx "
    if crossing or model.decode(model.encode(probe)) != probe:
        raise ValueError("the model's pieces cross white space, or it rewrites texts")


class ChunkTable:
    def __init__(self, path: str, table_size: int = 500_000, table_chars: int = 20_000_000, long_chunk: int = 1000):
        from sentencepiece import SentencePieceProcessor

        self.model, self.table_size, self.table_chars, self.long_chunk = SentencePieceProcessor(model_file=path), table_size, table_chars, long_chunk
        self.chars = 0
        check_model(self.model)
        self.ids: dict[str, list[int]] = {}
        self.begin, self.end = [self.model.bos_id()], [self.model.eos_id()]

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.array(self.begin + self.end, dtype="<u4")
        chunks = CHUNK.findall(" " + text)
        if len(self.ids) > self.table_size or self.chars > self.table_chars:
            self.ids.clear()
            self.chars = 0
        new = [c for c in dict.fromkeys(chunks) if c not in self.ids]
        if new:  # the library puts the first marker itself
            self.ids.update(zip(new, self.model.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1)))
            if " " in new or MARK in new:  # a lone marker: the library gives none for an empty text
                lone = [self.model.piece_to_id(MARK)]
                self.ids.update({c: lone for c in (" ", MARK) if c in new})
            self.chars += sum(map(len, new))
        out = np.array(list(chain(self.begin, *map(self.ids.__getitem__, chunks), self.end)), dtype="<u4")
        for c in new:
            if len(c) > self.long_chunk:
                del self.ids[c]
                self.chars -= len(c)
        return out


def encoded(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """`keep`, n_tokens, ids_sha256, decoded_sha256, and with_ids: ids and decoded themselves."""
    path = path or public_tokenizers.path(MODEL)
    fields = [f for c in keep for f in docs.schema.fields if f.name == c]
    names = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n_tokens long, ids_sha256 string, decoded_sha256 string", *["ids array<int>, decoded string"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            counts, shas, back, all_ids, decoded = [], [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                ids = table.encode(text.as_py() or "")
                whole = table.model.decode(ids.tolist())
                counts.append(len(ids))
                shas.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
                    decoded.append(whole)
            out = [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*[f.name for f in fields], *names])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text_col).alias("text__")).mapInArrow(run, schema)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
