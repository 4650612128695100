"""Byte-level BPE encoding and decoding with segment trees.

A text is cut into pieces by the vocabulary's pattern, each piece is merged by itself. The tree of a piece has a
leaf for every byte position and holds, in each node, the least (rank, position) of the pairs of neighbouring
tokens that begin below it; its root is the leftmost pair of least rank. A merge joins the token at that position
with its live right neighbour and changes three leaves: the position itself, the neighbour, which is dead from
then on, and the position of the live left neighbour. Each change climbs one path to the root.

Short pieces are many and alike, so trees of one size are kept as rows of one array and take their merges
together (:func:`merge_together`); a long piece has a tree of its own (:func:`merge_one`).

Pieces meet no white space but at their start, so a text can be cut before each space between two other characters. The
ids of such chunks are remembered by each task, up to a bound, since words come again.

Null texts are empty; an empty text has no ids, its digest is that of no bytes. Every byte has a token, so any text is
encoded and comes back the same. Very long texts are taken in blocks of chunks, very long pieces in one
tree of their own. Repeated rows give repeated results. Rows keep all their columns; the new column's name must be
free, else ``ValueError``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow.llm.registry import query, table

NONE = np.iinfo(np.int64).max
#: Bytes up to which pieces of one tree size are merged together.
SHORT = 64
#: Leaves of the trees that are merged together.
LEAVES = 1 << 20
#: Characters of text that a task takes at once, and chunks whose ids it remembers.
BLOCK = 1 << 22
REMEMBERED = 1 << 19
#: The characters of Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


class Vocabulary:
    """The tokens of a rank file and the ranks of all pairs of tokens that make a token."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: No token has this number; a pair with it has no rank.
        self.end = len(self.tokens)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * (self.end + 1) + right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where it makes no token."""
        keys = left * (self.end + 1) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


def merge_one(piece: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one piece by a tree of its own; memory in proportion to the piece."""
    pairs, base, n = vocabulary.pairs, vocabulary.end + 1, len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    ids = vocabulary.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(ids[i] * base + ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(place: int, rank: int | None) -> None:
        node, value = size + place, NONE if rank is None else rank * size + place
        while node and tree[node] != value:
            tree[node] = value
            node >>= 1
            value = min(tree[2 * node], tree[2 * node + 1])

    live = [True] * n
    while tree[1] != NONE:
        rank, place = divmod(tree[1], size)
        gone = after[place]
        following, left = after[gone], before[place]
        ids[place], live[gone], after[place] = rank, False, following
        put(gone, None)
        if following < n:
            before[following] = place
            put(place, pairs.get(rank * base + ids[following]))
        else:
            put(place, None)
        if left >= 0:
            put(left, pairs.get(ids[left] * base + rank))
    return [token for token, there in zip(ids, live) if there]


def merge_together(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids (little-endian, four bytes each) of pieces of 2 to ``SHORT`` bytes, their trees as rows of one array."""
    longest = max(map(len, pieces))
    size, n = 1 << max(1, (longest - 1).bit_length()), len(pieces)
    shift = size.bit_length() - 1
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
    there = np.arange(size) < lengths[:, None]
    # One more place at the right stands for "no token"; what lies beyond a piece points to it.
    ids = np.full((n, size + 1), vocabulary.end, np.int64)
    ids[:, :size][there] = vocabulary.byte_ids[raw[there]]
    after = np.broadcast_to(np.arange(1, size + 2), (n, size + 1)).copy()
    after[np.arange(size + 1) >= (lengths - 1)[:, None]] = size
    before = np.broadcast_to(np.arange(-1, size), (n, size + 1)).copy()
    tree = np.full((n, 2 * size), NONE, np.int64)
    first = vocabulary.rank_of(ids[:, :-1], ids[:, 1:])
    tree[:, size:] = np.where(first == NONE, NONE, (first << shift) | np.arange(size))
    width = size
    while width > 1:
        tree[:, width // 2 : width] = np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2])
        width //= 2
    live = there.copy()
    flat_ids, flat_after, flat_before, flat_tree, flat_live = ids.ravel(), after.ravel(), before.ravel(), tree.ravel(), live.ravel()
    rows = np.arange(n)
    while True:
        top = flat_tree[rows * (2 * size) + 1]
        on = top != NONE
        rows, top = rows[on], top[on]
        if not len(rows):
            break
        place, rank = top & (size - 1), top >> shift
        across, climbing = rows * (size + 1), rows * (2 * size)
        gone = flat_after[across + place]
        following, left = flat_after[across + gone], flat_before[across + place]
        flat_ids[across + place] = rank
        flat_live[rows * size + gone] = False
        flat_after[across + place] = following
        flat_before[across + following] = place
        own = vocabulary.rank_of(rank, flat_ids[across + following])
        has_left = left >= 0
        beside = np.where(has_left, vocabulary.rank_of(flat_ids[across + np.maximum(left, 0)], rank), NONE)
        # A piece's first token has no left neighbour; its path is then climbed from the position itself.
        left = np.where(has_left, left, place)
        flat_tree[climbing + size + gone] = NONE
        flat_tree[climbing + size + place] = np.where(own == NONE, NONE, (own << shift) | place)
        with_left = np.flatnonzero(has_left)
        flat_tree[(climbing + size + left)[with_left]] = np.where(beside == NONE, NONE, (beside << shift) | left)[with_left]
        paths = [size + place, size + gone, size + left]
        for _ in range(shift):
            paths = [path >> 1 for path in paths]
            for path in paths:
                node = climbing + path
                child = climbing + 2 * path
                flat_tree[node] = np.minimum(flat_tree[child], flat_tree[child + 1])
    out, counts = ids[:, :size][live].astype("<u4").tobytes(), live.sum(axis=1)
    ends = (4 * np.cumsum(counts)).tolist()
    return [out[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Ids of texts as bytes, little-endian and four for each id."""

    def __init__(self, vocabulary: Vocabulary, pattern: str | None = None, remembered: int = REMEMBERED):
        import public_tokenizers
        import regex

        self.vocabulary, self.remembered = vocabulary, remembered
        self.pieces_of = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _merged(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of distinct pieces: a token as it stands has one id, others are merged."""
        ranks, out = self.vocabulary.ranks, {}
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = ranks.get(raw)
            if rank is not None:
                out[piece] = rank.to_bytes(4, "little")
            elif len(raw) > SHORT:
                out[piece] = np.array(merge_one(raw, self.vocabulary), "<u4").tobytes()
            else:
                sized.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for log2, same in sized.items():
            step = LEAVES >> max(1, log2)
            for start in range(0, len(same), step):
                some = same[start : start + step]
                out.update(zip((p for p, _ in some), merge_together([raw for _, raw in some], self.vocabulary)))
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Remember the ids of new chunks."""
        if len(self.pieces) > self.remembered:
            self.pieces.clear()
        cut = {chunk: self.pieces_of(chunk) for chunk in chunks}
        new = {piece for pieces in cut.values() for piece in pieces}.difference(self.pieces)
        self.pieces.update(self._merged(list(new)))
        known = self.pieces
        for chunk, pieces in cut.items():
            self.chunks[chunk] = known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts are taken together, so that equal pieces are merged once."""
        parts: list[list[str]] = [chunks_of(text) for text in texts]
        new: set[str] = set()
        for chunks in parts:
            new.update(chunks)
        # Where the bound is passed the memory is cleared as a whole; all chunks of this block are then new.
        if len(self.chunks) + len(new) > self.remembered:
            self.chunks.clear()
        self._learn(new.difference(self.chunks))
        ids = self.chunks
        return [b"".join([ids[c] for c in chunks]) for chunks in parts]


def chunks_of(text: str) -> list[str]:
    """The text cut before each space that stands between two other characters than white space."""
    if not text:
        return []
    words = text.split(" ")
    chunks = words[:1] + [" " + w for w in words[1:]]
    if not any(w + " " in text or " " + w in text for w in WHITE if w in text) and text[0] != " " and text[-1] != " ":
        return chunks
    out, open_ = [words[0]], words[0] == "" or words[0][-1] in WHITE
    for word in words[1:]:
        if open_ or word == "" or word[0] in WHITE:
            out[-1] += " " + word
        else:
            out.append(" " + word)
        open_ = word == "" or word[-1] in WHITE
    return out


def blocks_of(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in blocks of about ``size`` characters, cut where chunks are cut."""
    start = 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at >= 0 and (at + 1 >= len(text) or text[at - 1] in WHITE or text[at + 1] in WHITE):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def _with_column(rows: DataFrame, out: str) -> T.StructType:
    if out in rows.columns:
        raise ValueError(f"column {out!r} is there already; name another")
    return T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])


def encoded(docs: DataFrame, text: str = "text", out: str = "token_ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows with the ids of ``text`` as bytes, four for each id, little-endian.

    ``ranks`` is a rank file that every executor can open, by default the multilingual one of the public tokenizers.
    """
    schema, place = _with_column(docs, out), docs.columns.index(text)

    def run(batches):
        import public_tokenizers

        encoder = Encoder(Vocabulary(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern)
        for batch in batches:
            start, size, texts = 0, 0, []
            for row, value in enumerate(batch.column(place)):
                texts.append(value.as_py() or "")
                size += len(texts[-1])
                if size >= BLOCK or row == batch.num_rows - 1:
                    if len(texts) == 1:
                        ids = [b"".join(encoder.encode([block])[0] for block in blocks_of(texts[0]))]
                    else:
                        *most, last = texts
                        ids = [*encoder.encode(most), b"".join(encoder.encode([block])[0] for block in blocks_of(last))]
                    part = batch.slice(start, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], schema.names)
                    start, size, texts = row + 1, 0, []

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, ids: str = "token_ids", out: str = "decoded", ranks: str | None = None) -> DataFrame:
    """The rows with the bytes that ``ids`` stand for; null ids give null, an unknown id fails."""
    schema, place = _with_column(rows, out), rows.columns.index(ids)

    def run(batches):
        import public_tokenizers

        tokens = Vocabulary(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).tokens.__getitem__
        for batch in batches:
            values = []
            for value in batch.column(place):
                raw = value.as_buffer()
                values.append(None if raw is None else b"".join(map(tokens, np.frombuffer(raw, "<u4").tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


@query("op13_byte_pairs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they stand for; tested against the library's own encoder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = decoded(encoded(docs).drop("text"))
    return both.select(
        "doc_id", F.floor(F.length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
