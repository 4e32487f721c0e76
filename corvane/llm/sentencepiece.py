"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Words of equal length form one matrix and advance together: the hashes of all their substrings probe the sorted hashes of pieces, and at
each end position a vectorised maximum over the admissible pieces that end there stores the best one and its backpointer.

The public model is of the BPE kind: a path is right if merging by piece scores would give it, not if its score is largest.
So a transition is admissible only if merging the two adjoining pieces' characters alone gives back the two pieces; exactly
one admissible piece then ends at each position, and the maximum picks it. Pairs are judged in numpy by undoing merges, and
remembered. Characters without a piece become byte pieces.

Defined edges: null and empty texts have no ids. A literal U+2581 decodes as a space, as the format has it, so such a text does
not round-trip. Texts are encoded whole. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
SLOTS = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The model's pieces as sorted hashes, and which pairs of pieces may adjoin."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw = [b""] * n
        for i, piece in text.items():
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.raw[i] = bytes([b])
        # own numbers: characters first, then merged pieces in the order in which merging takes them
        order = sorted(plain, key=lambda i: (len(text[i]) > 1, -model.get_score(i), i))
        self.ids = np.array(order, dtype=np.int64)
        self.texts = [text[i] for i in order]
        number = {t: k for k, t in enumerate(self.texts)}
        self.left, self.right = (np.arange(len(order)) for _ in range(2))
        pairs, sound = {}, np.ones(len(order), dtype=bool)
        for k, t in enumerate(self.texts):
            for cut in range(1, len(t)):
                a, b = number.get(t[:cut]), number.get(t[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = k
            if len(t) > 1:
                found = self.last_merge(t, number)
                sound[k] = found is not None
                if found:
                    self.left[k], self.right[k] = found
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_to = np.array([pairs[p] for p in self.pair_keys.tolist()], dtype=np.int64)
        self.longest = max(map(len, self.texts))
        hashes = np.zeros(len(order), dtype=np.uint64)
        for length in range(1, self.longest + 1):
            own = [k for k, t in enumerate(self.texts) if len(t) == length and sound[k]]
            if own:
                hashes[own] = self.prefix_hashes(self.matrix([self.texts[k] for k in own], length))[:, -1]
        self.by_length = {}
        for length in range(1, self.longest + 1):
            own = np.array([k for k, t in enumerate(self.texts) if len(t) == length and sound[k]], dtype=np.int64)
            own = own[np.argsort(hashes[own])]
            self.by_length[length] = (hashes[own], own)
        self.power = np.array([pow(int(PRIME), e, 1 << 64) for e in range(self.longest + 1)], dtype=np.uint64)
        # hash bits of pieces of each length: most substrings are no piece and stop here
        self.sieve = {}
        for length, (hashed, _) in self.by_length.items():
            self.sieve[length] = np.zeros(SLOTS, dtype=bool)
            self.sieve[length][(hashed >> np.uint64(44)).astype(np.int64)] = True
        self.known_pairs = np.full(SLOTS, -1, dtype=np.int64)
        self.known = np.zeros(SLOTS, dtype=bool)
        self.word = self.word_rule()

    def word_rule(self) -> re.Pattern:
        """Where texts may be cut into words: no piece spans a cut, so words merge by themselves.

        A line feed stands alone, a space mark starts a word unless one stands before it, and a word ends before a punctuation
        mark that no piece holds after a word character.
        """
        after = set()
        for t in self.texts:
            for x, y in zip(t, t[1:]):
                if "\n" in (x, y) or y == SPACE != x:
                    raise ValueError("a piece spans two words")
                if re.match(r"\w", x):
                    after.add(y)
        marks = "".join(re.escape(c) for c in ".,;:!?*#$%&|()[]{}<>=+-/\"'" if c not in after)
        plain = f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
        return re.compile(rf"{SPACE}*\w+(?=[{marks}])|{plain}" if marks else plain)

    @staticmethod
    def last_merge(t: str, number: dict[str, int]) -> tuple[int, int] | None:
        """The two pieces that merging joins last to form t, or None if merging never forms it."""
        parts = list(t)
        while len(parts) > 1:
            found = [(number[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in number]
            if not found or any(p not in number for p in parts):
                return None
            _, i = min(found)
            if len(parts) == 2:
                return number[parts[0]], number[parts[1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return None

    @staticmethod
    def matrix(words: list[str], length: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(-1, length).astype(np.uint64)

    @staticmethod
    def prefix_hashes(chars: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, modulo 2^64; column j covers j characters."""
        out = np.zeros((len(chars), chars.shape[1] + 1), dtype=np.uint64)
        for j in range(chars.shape[1]):
            mixed = (chars[:, j] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            out[:, j + 1] = out[:, j] * PRIME + (mixed ^ (mixed >> np.uint64(29)))
        return out

    def judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of pieces: whether merging the characters of both together gives just the two.

        Merges are undone from the last to the first on either side of the border. Two parts that touch there and could merge
        before the merge that was last undone would have done so; of equal merges, the left one goes first.
        """
        ok = np.ones(len(a), dtype=bool)
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        n_single = next((k for k, t in enumerate(self.texts) if len(t) > 1), len(self.texts))
        while len(live):
            key = (a[live] << 32) | b[live]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_to[at] < limit[live])
            ok[live[clash]] = False
            live = live[~clash]
            single_a, single_b = a[live] < n_single, b[live] < n_single
            live = live[~(single_a & single_b)]
            rank_a, rank_b = np.where(a[live] < n_single, -1, a[live]), np.where(b[live] < n_single, -1, b[live])
            undo_a = rank_a > rank_b
            x, y = live[undo_a], live[~undo_a]
            limit[x], limit[y] = a[x], b[y] + 1
            a[x], b[y] = self.right[a[x]], self.left[b[y]]
        return ok

    def adjoin(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """judge() with a memory of pairs seen: one pair a slot, later pairs replace earlier ones."""
        key = (a << 32) | b
        slot = ((key.astype(np.uint64) * PRIME) >> np.uint64(44)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.known_pairs[slot] != key)
        if len(new):
            fresh, where = np.unique(key[new], return_inverse=True)
            found = self.judge(fresh >> 32, fresh & 0xFFFFFFFF)
            out[new] = found[where]
            self.known_pairs[slot[new]], self.known[slot[new]] = key[new], found[where]
        return out

    def matches(self, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """end, row, piece, size of every substring that is a piece, by end and then piece; and which characters are pieces (length, row)."""
        prefix, (n, length) = np.ascontiguousarray(self.prefix_hashes(chars).T), chars.shape
        found, single = [], np.zeros((length, n), dtype=bool)
        for size in range(1, min(length, self.longest) + 1):
            hashes, own = self.by_length[size]
            if not len(own):
                continue
            probe = (prefix[size:] - prefix[: length + 1 - size] * self.power[size]).ravel()
            at = np.flatnonzero(self.sieve[size][(probe >> np.uint64(44)).view(np.int64)])
            near = np.minimum(np.searchsorted(hashes, probe[at]), len(hashes) - 1)
            hit = hashes[near] == probe[at]
            at, near = at[hit], near[hit]
            if size == 1:
                single.ravel()[at] = True
            found.append((at // n + size, at % n, own[near], np.full(len(at), size)))
        end, row, piece, size = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64) for _ in range(4))
        by = np.lexsort((piece, end))
        return end[by], row[by], piece[by], size[by], single

    def viterbi(self, words: list[str], length: int) -> list[bytes]:
        """Ids, as little-endian uint32 bytes, of words of one length."""
        n = len(words)
        end_of, rows, pieces, sizes, single = self.matches(self.matrix(words, length))
        at = np.searchsorted(end_of, np.arange(length + 2)).tolist()
        last = np.full((length + 1, n), -1, dtype=np.int64)  # piece that ends here; -2: a character without a piece
        back = np.zeros((length + 1, n), dtype=np.int64)
        last[0] = -2
        for end in range(1, length + 1):
            part = slice(at[end], at[end + 1])
            row, piece, size = rows[part], pieces[part], sizes[part]
            before = last[end - size, row]
            fine = before != -1
            inner = np.flatnonzero(before >= 0)
            if len(inner):
                fine[inner] = self.adjoin(before[inner], piece[inner])
            row = row[fine]
            last[end, row], back[end, row] = piece[fine], size[fine]  # by piece: the largest of a row is stored last and stays
            bare = np.flatnonzero((last[end] == -1) & ~single[end - 1])  # a character without a piece stands alone
            last[end, bare], back[end, bare] = -2, 1
        return self.paths(words, last, back, length)

    def paths(self, words: list[str], last: np.ndarray, back: np.ndarray, length: int) -> list[bytes]:
        """Follow the backpointers of all words together."""
        n = len(words)
        at, steps = np.full(n, length), []
        while (live := np.flatnonzero(at > 0)).size:
            piece = np.full(n, -1, dtype=np.int64)
            piece[live] = last[at[live], live]
            steps.append((piece, at.copy()))
            at[live] -= np.maximum(back[at[live], live], 1)
        table = np.stack([s[0] for s in reversed(steps)], axis=1)
        ids = np.where(table >= 0, self.ids[np.maximum(table, 0)], 0).astype("<u4")
        out = []
        odd = (table == -2).any(axis=1)
        count = (table >= 0).sum(axis=1)
        width = table.shape[1]
        raw, stride = ids.tobytes(), 4 * width
        for i, (bad, k) in enumerate(zip(odd.tolist(), count.tolist())):
            if not bad:
                out.append(raw[i * stride + 4 * (width - k) : (i + 1) * stride])
            else:
                own = []
                for j in range(width):
                    if table[i, j] >= 0:
                        own.append(int(ids[i, j]))
                    elif table[i, j] == -2:
                        end = int(steps[width - 1 - j][1][i])
                        own += [self.byte_ids[b] for b in words[i][end - 1].encode()]
                out.append(np.array(own, dtype="<u4").tobytes())
        return out

    def encode(self, texts: list[str], cache: dict[str, bytes], max_words: int = 1 << 20) -> list[bytes]:
        """Ids of each text, as little-endian uint32 bytes."""
        split = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(cache) > max_words:
            cache.clear()
        by_length: dict[int, list[str]] = {}
        for word in {w for parts in split for w in parts}:
            if word not in cache:
                by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            step = max(1, (1 << 20) // length)
            for first in range(0, len(words), step):
                chunk = words[first : first + step]
                cache.update(zip(chunk, self.viterbi(chunk, length)))
        return [b"".join([cache[w] for w in parts]) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD."""
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()])
        return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str = "", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ids array<int> of each whole text."""
    path = model or public_tokenizers.path(MODEL)
    rows = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = pieces(path), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = own.encode(part.column("text").to_pylist(), cache)
                ends = np.cumsum([0, *(len(x) // 4 for x in found)]).astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<u4").astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], names=[*keep, "ids"])

    return rows.mapInArrow(run, f"{ddl}, ids array<int>")


def decode_column(ids: pa.Array, own: Pieces) -> list[str]:
    """The texts of a list column."""
    flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
    return [own.decode(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def decode(rows: DataFrame, model: str = "") -> DataFrame:
    """doc_id and the text of ids array<int>."""
    path = model or public_tokenizers.path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, doc_id=batch.column("doc_id"), text=decode_column(batch.column("ids"), pieces(path)))

    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, model: str = "") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian uint32), decoded_sha256, exact (whether decoding gives the text back)."""
    path = model or public_tokenizers.path(MODEL)
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat, ends = batch.column("ids"), batch.column("ids").values.to_numpy(), batch.column("ids").offsets.to_numpy().tolist()
            shas = [hashlib.sha256(t.encode()).hexdigest() for t in decode_column(ids, pieces(path))]
            yield batch_of(
                schema, doc_id=batch.column("doc_id"), n_ids=[b - a for a, b in zip(ends, ends[1:])], decoded_sha256=shas,
                ids_crc32=[zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])], exact=[a == b for a, b in zip(shas, batch.column("sha").to_pylist())],
            )

    keyed = docs.select("doc_id", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("sha"))
    return encode(keyed, model, ("doc_id", "sha")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
