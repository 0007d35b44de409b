"""Token counts: pieces once per distinct pre-token, joined to the frequencies of each document.

Byte-pair merges never cross a pre-token, so a document's count is the sum over
its distinct pre-tokens of frequency times pieces. Each task keeps the pieces
of the pre-tokens it has met and encodes only new ones; no document's ids are
ever built and nothing is shuffled.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKEN_LIMIT = 512
#: Pre-tokens whose counts a task remembers before it starts anew.
KNOWN_PIECES = 300_000
#: Characters of text whose frequencies are joined at once.
CHUNK_CHARS = 1_000_000
#: Fixed value: how byte-level BPE vocabularies of this kind split text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with other characters are split by the library itself, whose classes may differ in detail.
PLAIN = regex.compile(r"[\t\n\r -~\xa1-ɏ‐-‧‰-⁞€]*+")


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts tokens as the tokenizer at ``path`` does, special strings in a text included."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN).findall
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of ``text`` with their counts, and its special strings."""
        parts, n_special = [text], 0
        if self.special is not None:
            parts = self.special.split(text)
            n_special = len(parts) - 1
        counts: Counter = Counter()
        for part in parts:
            if PLAIN.fullmatch(part):
                counts.update(self.split(part))
            elif part:
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
                counts.update(part[start:end] for _, (start, end) in pieces)
        return counts, n_special

    def count(self, texts: list[str]) -> list[int]:
        rows = [self.frequencies(t) for t in texts]
        new = list({piece for counts, _ in rows for piece in counts if piece not in self.known})
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.known = {}
            new = list({piece for counts, _ in rows for piece in counts})
        encoded = self.tokenizer.encode_batch(new, add_special_tokens=False)
        self.known.update(zip(new, map(len, encoded)))
        known = self.known
        return [sum(known[piece] * n for piece, n in counts.items()) + extra for counts, extra in rows]


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs(doc_id, text)``.

    ``path`` names a byte-level BPE tokenizer file that every executor can
    read. Special strings inside a text count as the library counts them by
    default; none are added, nothing is cut.

    Null and empty texts have no bytes and no tokens. Null and repeated ids
    keep a row each; other columns are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            totals, chunk, size = [], [], 0
            for text in batch.column(1):
                chunk.append(text.as_py() or "")
                size += len(chunk[-1])
                if size >= CHUNK_CHARS:
                    totals += counter.count(chunk)
                    chunk, size = [], 0
            totals += counter.count(chunk)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(totals, type=pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), "text", n_bytes.alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
