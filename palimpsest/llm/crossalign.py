"""Links between the tokens of two tokenizers, merged in lockstep.

Both tokenizers cut the same bytes. A document, or a stretch of tokens of a
long one, is a lane with a pointer into A's and one into B's tokens. All lanes
of a batch step together in one NumPy state: the two tokens pointed at overlap
and are a link; where they end together the byte offset is a cut; the pointer
of the token that ends first moves on, both at a cut. Finished lanes are
compacted away.

Links are stored a batch to a row, as places in the batch's sorted distinct id
pairs. Corpus-wide counts are a grouped table of pairs; each batch gets back
the counts of its own pairs, never more than it has links, so nothing that
grows with the corpus is held in one place.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tokens import default_path
from palimpsest.session import materialize, spread

# Bytes of text whose links are stored together; a longer document is a batch
# of its own.
BATCH_BYTES = 1 << 20
# A tokens of a lane.
LANE_TOKENS = 1024
_LATIN_END = "\u0250"
_MARK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable
    ones stand for themselves, the rest for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers of a worker: ids of a text and lengths of tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self._path_a, self._slow = path_a, None
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        alphabet = byte_alphabet()
        by_id = {i: token for token, i in vocabulary.items()}
        self.bytes_a = [
            bytes(map(alphabet.get, by_id[i])) if set(by_id.get(i, "")) <= alphabet.keys() else b""
            for i in range(max(by_id) + 1)
        ]
        # The same vocabulary as ranks, for text whose signs every version of
        # the pattern's character classes knows.
        ranks = {token: i for i, token in enumerate(self.bytes_a) if token}
        self._fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            as_byte = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
            self.bytes_b.append(
                bytes([int(piece[3:5], 16)]) if as_byte else piece.replace(_MARK, " ").encode()
            )
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)

    def ids_a(self, text: str) -> np.ndarray:
        if not text or max(text) < _LATIN_END:
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        if self._slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path_a)
            self._slow.encode_special_tokens = True
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A of blank and text and by B of the text; none where their
        bytes are not blank and text."""
        none = np.empty(0, np.uint32)
        if not text:
            return none, none
        plain = (" " + text).encode()
        b = self._b.encode(text)
        if b"".join(map(self.bytes_b.__getitem__, b)) != plain:
            return none, none
        a = self.ids_a(" " + text)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != plain:
            return none, none
        return a, np.array(b, np.uint32)


def lockstep(
    ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, lane_tokens: int = LANE_TOKENS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of all documents in order, and the tokens of A and B that end at
    a cut.

    ``ends_*`` are rising byte offsets of the tokens' ends over all documents,
    each of which ends at the same offset in both; ``bounds_a`` says where the
    documents begin among A's tokens. No token is empty.
    """
    sizes = np.diff(bounds_a)
    lanes = -(-sizes // lane_tokens)
    owner = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    i = bounds_a[owner] + nth * lane_tokens
    stop = np.minimum(i + lane_tokens, bounds_a[owner + 1])
    # B's token over the first byte of the lane: the first that ends behind it.
    begin = np.where(i > 0, ends_a[np.maximum(i, 1) - 1], 0) if len(i) else i
    j = np.searchsorted(ends_b, begin, "right")
    link_of = np.full(len(ends_a) + len(ends_b), -1, np.int64)
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    while len(i):
        a, b = ends_a[i], ends_b[j]
        # The sum of both places names a link: one of them moves at each step.
        link_of[i + j] = i
        both = a == b
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        step = a <= b
        j = j + (b <= a)
        i = i + step
        alive = i < stop
        if not alive.all():
            i, j, stop = i[alive], j[alive], stop[alive]
    at = np.flatnonzero(link_of >= 0)
    left = link_of[at]
    return left, at - left, cut_a, cut_b


def _digits(most: int) -> np.ndarray:
    """Decimal digits of 0 to ``most - 1``, filled up with zero bytes."""
    numbers = np.arange(max(1, most))
    width = len(str(int(numbers[-1])))
    powers = 10 ** np.arange(width - 1, -1, -1)
    shown = (numbers[:, None] >= powers) | (powers == 1)
    return np.where(shown, numbers[:, None] // powers % 10 + 48, 0).astype(np.uint8)


def group_texts(
    ids_a: np.ndarray,
    ids_b: np.ndarray,
    cut_a: np.ndarray,
    cut_b: np.ndarray,
    bounds_a: np.ndarray,
    bounds_b: np.ndarray,
    digits: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all documents one after the other, and where
    each begins; a document with tokens ends in one sign too many."""
    group_a = np.cumsum(cut_a) - cut_a
    group_b = np.cumsum(cut_b) - cut_b
    n_groups = int(cut_a.sum())
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=n_groups))))
    before_a = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=n_groups))))
    place_a = np.arange(len(ids_a)) + before_b[group_a]
    place_b = np.arange(len(ids_b)) + before_a[group_b + 1]
    width = max(d.shape[1] for d in digits) + 1
    cells = np.zeros((len(ids_a) + len(ids_b), width), np.uint8)
    for place, ids, cut, table, last in (
        (place_a, ids_a, cut_a, digits[0], b"|"),
        (place_b, ids_b, cut_b, digits[1], b";"),
    ):
        cells[place, width - 1 - table.shape[1] : width - 1] = table[ids]
        cells[place, width - 1] = np.where(cut, last[0], ord(","))
    used = cells != 0
    lengths = np.concatenate(([0], np.cumsum(used.sum(axis=1))))
    return cells[used], lengths[bounds_a + bounds_b]


@dataclass(frozen=True)
class Settings:
    tokenizer_a: str | None = None
    tokenizer_b: str | None = None


_BATCH = (
    "batch long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, digests array<string>, places binary, codes binary, counts binary"
)
_BATCH_SCHEMA = pa.schema(
    [("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("digests", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("places", "codes", "counts")]
)
_PAIRS: dict[tuple[str, str], Pair] = {}


def _bounds(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def aligned(
    parts_a: list[np.ndarray], parts_b: list[np.ndarray], pair: Pair
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Tokens of each side of all links, links and groups per document, and
    the documents' group texts."""
    bounds_a, bounds_b = _bounds(parts_a), _bounds(parts_b)
    ids_a, ids_b = np.concatenate(parts_a), np.concatenate(parts_b)
    ends_a, ends_b = np.cumsum(pair.length_a[ids_a]), np.cumsum(pair.length_b[ids_b])
    left, right, cut_a, cut_b = lockstep(ends_a, ends_b, bounds_a)
    n_links = np.diff(np.searchsorted(left, bounds_a))
    cuts = np.concatenate(([0], np.cumsum(cut_a)))
    digits = _digits(len(pair.length_a)), _digits(len(pair.length_b))
    text, begins = group_texts(ids_a, ids_b, cut_a, cut_b, bounds_a, bounds_b, digits)
    data = text.tobytes()
    texts = [data[x : max(x, y - 1)] for x, y in zip(begins[:-1], begins[1:], strict=True)]
    return ids_a[left], ids_b[right], n_links, np.diff(cuts[bounds_a]), texts


def links(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Aligned documents, a batch of them to a row, stored in the shared folder.

    Arrays hold an entry per document; ``places`` has for every link, in order,
    the place of its id pair in ``codes`` (A's id times 2**32 plus B's, rising) in
    two bytes, four where a batch has over 65,536 pairs, and ``counts`` how many
    links of the batch have the pair.
    """
    settings = settings or Settings()
    paths = settings.tokenizer_a or default_path(), settings.tokenizer_b or default_pieces()

    def batch_row(number: int, ids: list, a: list, b: list, pair: Pair) -> pa.RecordBatch:
        link_a, link_b, n_links, n_groups, texts = aligned(a, b, pair)
        code = (link_a.astype(np.int64) << 32) | link_b
        codes, places, counts = np.unique(code, return_inverse=True, return_counts=True)
        row = (
            number,
            ids,
            [len(x) for x in a],
            [len(x) for x in b],
            n_groups.tolist(),
            n_links.tolist(),
            [hashlib.sha256(t).hexdigest() if t else "" for t in texts],
            places.astype("<u2" if len(codes) <= 1 << 16 else "<u4").tobytes(),
            codes.astype("<i8").tobytes(),
            counts.astype("<i8").tobytes(),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([v], f.type) for v, f in zip(row, _BATCH_SCHEMA, strict=True)],
            schema=_BATCH_SCHEMA,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _PAIRS:
            _PAIRS[paths] = Pair(*paths)
        pair = _PAIRS[paths]
        number = TaskContext.get().partitionId() << 32
        ids, a, b, held = [], [], [], 0
        for batch in batches:
            column = batch.column("text")
            for doc_id, i in zip(batch.column("doc_id").to_pylist(), range(len(column)), strict=True):
                text = column[i].as_py()
                if ids and held + len(text or "") > BATCH_BYTES:
                    yield batch_row(number, ids, a, b, pair)
                    number += 1
                    ids, a, b, held = [], [], [], 0
                x, y = pair.encode(text)
                ids.append(doc_id)
                a.append(x)
                b.append(y)
                held += len(text or "")
        if ids:
            yield batch_row(number, ids, a, b, pair)

    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return materialize(spread(named, "doc_id").mapInArrow(run, _BATCH), "links")


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, codes, counts in zip(
            *(batch.column(c).to_pylist() for c in ("batch", "codes", "counts")), strict=True
        ):
            codes = np.frombuffer(codes, "<i8")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(codes), number)),
                    pa.array(codes),
                    pa.array(np.frombuffer(counts, "<i8")),
                ],
                ["batch", "code", "n"],
            )


def pair_counts(stored: DataFrame) -> DataFrame:
    """``a, b, count`` of every id pair with a link, over the whole corpus."""
    rows = stored.select("batch", "codes", "counts").mapInArrow(_pair_rows, "batch long, code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("count")).select(
        F.shiftright("code", 32).alias("a"),
        F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"),
        "count",
    )


_DOC = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
    "count_sum long, groups_sha256 string"
)


def _scored(key: tuple, stored: pa.Table, known: pa.Table) -> pa.Table:
    """Documents of one batch; ``known`` has the counts of its pairs."""
    row = stored.to_pylist()[0]
    order = np.argsort(known.column("code").to_numpy())
    count = known.column("count").to_numpy()[order]
    best = known.column("best").to_numpy(zero_copy_only=False)[order]
    links = sum(row["n_links"])
    places = np.frombuffer(row["places"], "<u2" if len(row["places"]) == 2 * links else "<u4")
    sums = np.concatenate(([0], np.cumsum(count[places])))
    bests = np.concatenate(([0], np.cumsum(best[places])))
    bounds = np.concatenate(([0], np.cumsum(np.array(row["n_links"], np.int64))))
    columns = {c: row[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(
        {
            "doc_id": pa.array(columns.pop("doc_ids"), pa.int64()),
            **{c: pa.array(v, pa.int64()) for c, v in columns.items()},
            "n_best": pa.array(np.diff(bests[bounds]), pa.int64()),
            "count_sum": pa.array(np.diff(sums[bounds]), pa.int64()),
            "groups_sha256": pa.array(row["digests"], pa.string()),
        }
    )


def align(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Every document with its token counts, groups and links.

    ``n_best`` counts the links whose pair is the most frequent of its B id in
    the corpus, ties included; ``count_sum`` adds up the corpus counts of the
    links' pairs. A null or empty text, or one whose tokens are not its bytes,
    has no tokens: zeros and an empty digest. Ids may be null or repeat. An
    empty table gives no row.
    """
    stored = links(docs, settings)
    counts = materialize(pair_counts(stored), "pairs")
    # A row per id of B: at most its vocabulary.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(F.broadcast(most), "b").select(
        (F.shiftleft(F.col("a"), 32) + F.col("b")).alias("code"),
        "count",
        (F.col("count") == F.col("most")).cast("long").alias("best"),
    )
    wanted = stored.select("batch", "codes", "counts").mapInArrow(
        _pair_rows, "batch long, code long, n long"
    )
    answered = wanted.drop("n").join(known, "code").groupBy("batch")
    rows = stored.drop("codes", "counts").groupBy("batch")
    return rows.cogroup(answered).applyInArrow(_scored, _DOC)
