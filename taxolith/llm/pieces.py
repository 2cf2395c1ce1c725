"""SentencePiece encoding and decoding of a byte-fallback BPE model, by backtracking instead of a merge queue.

A blank is the symbol ▁ and one is put before the text. No piece holds ▁ behind another character, so no merge crosses
the start of a run of ▁: a text is encoded run by run, and runs are remembered. Characters that are no piece become
bytes and end a stretch of merging.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.bpe import Memory, Merges

BLANK = "▁"
MODEL = "piece_bpe_32k.model"


class Codec:
    """encode(text) → ids, decode(ids) → text, of the model file at path."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank behind another character")
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # of pairs to merge, the one whose piece has the highest score comes first
        order = {p: r for r, p in enumerate(sorted(self.ids, key=lambda p: (-model.get_score(self.ids[p]), self.ids[p])))}
        self.merges = Merges(self.ids, lambda a, b: order.get(a + b))
        self.out = [b""] * n
        for piece, i in self.ids.items():
            self.out[i] = piece.replace(BLANK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.out[i] = bytes([b])
        self.words = Memory(lambda word: self._run(BLANK + word))

    def _run(self, run: str) -> tuple[int, ...]:
        """Ids of a run of blanks and what follows it."""
        found: list[int] = []
        for known, chars in itertools.groupby(run, self.ids.__contains__):
            stretch = "".join(chars)
            if known:
                found += map(self.ids.__getitem__, self.merges.encode(stretch))
            else:
                found += (self.bytes[b] for b in stretch.encode("utf-8", "surrogatepass"))
        return tuple(found)

    def encode(self, text: str | None) -> list[int]:
        """Null and empty texts have no ids."""
        if not text:
            return []
        words = text.replace(BLANK, " ").split(" ")
        if "" not in words:
            return list(itertools.chain.from_iterable(map(self.words.__getitem__, words)))
        found: list[int] = []
        blanks = 0
        for word in words:
            if word:
                found += self._run(BLANK * (blanks + 1) + word) if blanks else self.words[word]
                blanks = 0
            else:
                blanks += 1
        if blanks:
            found += self._run(BLANK * blanks)
        return found

    def decode(self, ids) -> str:
        """The text of ids; the blank that encoding put before it goes; broken UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.out.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids, of every row's whole text.

    Null texts count as empty: no ids, the digest of nothing. Null identifiers and repeated rows pass through. path is
    the model file on the executors; by default the public one of that installation.
    """

    def run(batches):
        c = codec(path or model_path())
        for b in batches:
            counts, digests, decoded, all_ids = [], [], [], []
            for text in b.column("text").to_pylist():
                ids = c.encode(text)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"))
