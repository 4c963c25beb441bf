"""SentencePiece encoding and decoding with array operations over batches of words.

The model file is a BPE model with byte fallback, so the right segmentation is the one that its merges make, not
the one of largest score. It can still be found by a Viterbi pass: in the segmentation that BPE makes of a text,
every prefix that ends with a piece is segmented as it would be alone, so for each position there is one piece
that may end there, the one that is compatible with the piece before it (BPE of the two strings gives just the
two pieces). Words of equal length advance together, one position at a time; substring hashes probe the sorted
hashes of the pieces; and the maximum over the candidates' compatibility and scores is stored as backpointer.

Pieces never hold a word border but at their start (checked when a model is read), so texts are cut into words
that begin with spaces, and each distinct word is segmented once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import U64, mix64, slices
from .bpe import WordEncoder

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: A code point's random code, and the odd base of prefix hashes.
_BASE = U64(0x9E3779B97F4A7C15)
#: So many spaces that their merges may overlap.
_RUN = SPACE * 8
#: Cells (words times positions) that advance together; two to the power of the kept answers on pairs.
CHUNK_CELLS, PAIR_BITS = 1 << 18, 20


class Model:
    """Pieces of a BPE model with byte fallback, sorted by hash, and the merge that makes each of them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(self.size)]
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        self.special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        plain = [i for i in range(self.size) if i not in self.special and i not in self.byte_of]
        if any(SPACE in self.pieces[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece of this model crosses words")
        self.longest = max(len(self.pieces[i]) for i in plain)
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        # A piece that its own string's merges don't end in never comes up.
        plain = self._merges(plain)
        points = [np.array([ord(c) for c in self.pieces[i]], np.int64) for i in plain]
        hashes = np.array([self._prefix(p[None, :])[0, -1] for p in points], U64)
        order = np.argsort(hashes)
        self.hash, self.ident = hashes[order], np.array(plain, np.int64)[order]
        lead = (self.hash >> U64(44)).astype(np.int64)
        self.slot = np.full(1 << 20, -1, np.int64)
        self.slot[lead] = np.arange(len(lead))
        self.crowded = np.bincount(lead, minlength=1 << 20)[lead] > 1
        self.pair_key = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_stays = np.zeros(1 << PAIR_BITS, bool)

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        """(n, length + 1) hashes of the prefixes of equally long words."""
        out = np.zeros((points.shape[0], points.shape[1] + 1), U64)
        codes = mix64(points.astype(U64) + U64(0x51ED27))
        for j in range(points.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + codes[:, j]
        return out

    def _merges(self, plain: list[int]) -> list[int]:
        """Finds the left and right part of each piece's last merge; returns the pieces that merges make."""
        whole = []
        self.ids = ids = {self.pieces[i]: i for i in plain}
        self.left, self.right = np.arange(self.size), np.arange(self.size)
        self.made: dict[tuple[int, int], int] = {}
        for i in plain:
            parts = list(self.pieces[i])
            while len(parts) > 1:
                joined = [(self.score[ids[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
                if not joined:
                    break
                k = -max(joined)[1]
                if len(parts) == 2 and parts[0] in ids and parts[1] in ids:
                    self.left[i], self.right[i] = ids[parts[0]], ids[parts[1]]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1:
                whole.append(i)
        # Order in which merges happen: greater score first. Single characters come before all.
        rank = np.empty(self.size, np.int64)
        rank[np.argsort(-self.score, kind="stable")] = np.arange(self.size)
        single = np.array([len(p) == 1 for p in self.pieces])
        self.rank = np.where(single, -1, rank)
        # A piece is there once the last of the merges that it needs has come.
        self.until = self.rank.copy()
        for i in sorted(plain, key=lambda i: len(self.pieces[i])):
            if self.left[i] != i:
                self.until[i] = max(self.rank[i], self.until[self.left[i]], self.until[self.right[i]])
        return whole

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each substring hash, or -1; a table by leading bits spares most of the binary searches."""
        slot = self.slot[(hashes >> U64(44)).astype(np.int64)]
        out = np.where((slot >= 0) & (self.hash[slot] == hashes), self.ident[slot], -1)
        maybe = np.flatnonzero((out < 0) & (slot >= 0) & self.crowded[slot])
        if len(maybe):
            asked = hashes[maybe]
            at = np.minimum(np.searchsorted(self.hash, asked), len(self.hash) - 1)
            out[maybe] = np.where(self.hash[at] == asked, self.ident[at], -1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE of each pair's two strings leaves the border between them; answers are kept in a table of
        fixed size, in which a newer pair takes the place of an older one of the same slot."""
        pair = a * self.size + b
        slot = (mix64(pair) >> U64(64 - PAIR_BITS)).astype(np.int64)
        unknown = np.flatnonzero(self.pair_key[slot] != pair)
        if len(unknown):
            fresh, back = np.unique(pair[unknown], return_inverse=True)
            stays = np.array([self._border_stays(*divmod(x, self.size)) for x in fresh.tolist()])
            if len(self.made) > 1_000_000:
                self.made.clear()
            out = self.pair_stays[slot]
            out[unknown] = stays[back]
            at = (mix64(fresh) >> U64(64 - PAIR_BITS)).astype(np.int64)
            self.pair_key[at], self.pair_stays[at] = fresh, stays
            # Of pairs that share a slot the last write holds; keep key and answer of the same one.
            self.pair_stays[at] = stays[np.searchsorted(fresh, self.pair_key[at])]
            return out
        return self.pair_stays[slot]

    def _border_stays(self, a: int, b: int) -> bool:
        """Merges are undone from the last to the first on either side of the border; it falls if at some time
        a merge across it would have come before the next merge that did happen."""
        left = [(10**9, a)]  # states of the last part of a's string: valid until the merge of this rank happens
        while self.left[left[-1][1]] != left[-1][1]:
            p = left[-1][1]
            left.append((int(self.until[p]), int(self.right[p])))
        right = [(10**9, b)]
        while self.left[right[-1][1]] != right[-1][1]:
            p = right[-1][1]
            right.append((int(self.until[p]), int(self.left[p])))
        # In time order: the part next to the border at the time before the merge of that rank.
        i, j = len(left) - 1, len(right) - 1
        while True:
            until = min(left[i][0], right[j][0])
            x, y = left[i][1], right[j][1]
            across = self._joined(x, y)
            if across >= 0:
                when = int(self.rank[across])
                # Ties go to the leftmost pair: a merge in a's string at the same rank comes before the border's.
                if when < until or (when == until and left[i][0] > until):
                    return False
            if until == 10**9:
                return True
            if left[i][0] == until:
                i -= 1
            else:
                j -= 1

    def _joined(self, x: int, y: int) -> int:
        key = (x, y)
        if key not in self.made:
            points = np.array([[ord(c) for c in self.pieces[x] + self.pieces[y]]], np.int64)
            self.made[key] = int(self.find(self._prefix(points)[:, -1])[0])
        return self.made[key]

    def merge(self, word: str) -> list[int]:
        """Ids of one word by making its merges in order; for words behind a long run of spaces, in which equal
        merges overlap so that pairs of pieces don't tell where borders stay."""
        parts = list(word)
        ids = self.ids
        while len(parts) > 1:
            joined = [(self.score[ids[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
            if not joined:
                break
            k = -max(joined)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [i for p in parts for i in ([ids[p]] if p in ids else [self.byte.get(b, self.unknown) for b in p.encode("utf-8", "replace")])]

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has; words of equal length go through together."""
        sizes = np.array([len(w) for w in words], np.int64)
        count = np.zeros(len(words), np.int64)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        for i, w in enumerate(words):
            if w.startswith(_RUN):
                # Spaces merge in pairs, fours and so on from the left: all but the last are pieces of the longest kind.
                run = len(w) - len(w.lstrip(SPACE))
                block = max(k for k in range(1, self.longest + 1) if SPACE * k in self.ids and k & (k - 1) == 0)
                skip = max(0, run - 2 * block) // block
                ids = [self.ids[SPACE * block]] * skip + self.merge(w[skip * block :])
                sizes[i], count[i] = 0, len(ids)
                made.append((np.full(len(ids), i), np.array(ids, np.int64)))
        for size in np.unique(sizes[sizes > 0]):
            mine = np.flatnonzero(sizes == size)
            step = max(1, CHUNK_CELLS // int(size))
            for a in range(0, len(mine), step):
                part = mine[a : a + step]
                points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), size).astype(np.int64)
                owner, ids = self._viterbi(points)
                count[part] = np.bincount(owner, minlength=len(part))
                made.append((part[owner], ids))
        if not made:
            return np.zeros(0, np.uint32), count
        owner, ids = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        return ids[np.argsort(owner, kind="stable")].astype(np.uint32), count

    def _viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word number and id of each piece, word by word and in order."""
        n, size = points.shape
        prefix = self._prefix(points)
        power = np.full(self.longest + 1, _BASE, U64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        # best[:, j]: piece that ends at j, or size + code point for a character that is no piece (bytes).
        best = np.full((n, size + 1), -1, np.int64)
        best[:, 0] = self.size
        rows = np.arange(n)
        for j in range(1, size + 1):
            reach = min(j, self.longest)
            lengths = np.arange(1, reach + 1)
            piece = self.find((prefix[:, j, None] - prefix[:, j - lengths] * power[lengths]).ravel()).reshape(n, reach)
            piece[:, 0] = np.where(piece[:, 0] < 0, self.size + points[:, j - 1], piece[:, 0])
            before = best[:, j - lengths]
            value = np.full((n, reach), -np.inf)
            r, c = np.nonzero((piece >= 0) & (before >= 0))
            p, q = before[r, c], piece[r, c]
            good = (p >= self.size) | (q >= self.size)
            inner = np.flatnonzero(~good)
            good[inner] = self.compatible(p[inner], q[inner])
            r, c, q = r[good], c[good], q[good]
            value[r, c] = np.where(q >= self.size, -1e18, self.score[np.minimum(q, self.size - 1)])
            top = value.argmax(1)
            best[:, j] = np.where(value[rows, top] > -np.inf, piece[rows, top], -1)
        # All words step back together; a column of ids per step, the last pieces first.
        at, steps = np.full(n, size), []
        while at.any():
            now = np.where(at > 0, best[rows, at], -1)
            steps.append(now)
            at = np.where(at > 0, at - np.where(now >= self.size, 1, self.length[np.clip(now, 0, self.size - 1)]), 0)
        ids = np.stack(steps[::-1], axis=1)
        owner, step = np.nonzero(ids >= 0)
        ids = ids[owner, step]
        odd = np.flatnonzero(ids >= self.size)
        if len(odd):
            kinds, back = np.unique(ids[odd], return_inverse=True)
            raw = [[self.byte.get(b, self.unknown) for b in chr(int(k) - self.size).encode("utf-8", "replace")] for k in kinds]
            n_raw = np.ones(len(ids), np.int64)
            n_raw[odd] = np.array([len(x) for x in raw])[back]
            first = np.cumsum(n_raw) - n_raw
            owner, ids = np.repeat(owner, n_raw), np.repeat(ids, n_raw)
            for k, x in enumerate(raw):
                for o, b in enumerate(x):
                    ids[first[odd[back == k]] + o] = b
        return owner, ids


class Codec(WordEncoder):
    """Encodes and decodes whole texts. Words are what single spaces part; a word that begins with a line break
    (which no piece holds) stands for one that follows it without a space, any other for one behind a space."""

    def __init__(self, path: str, max_words: int = 400_000):
        self.model = Model(path)
        self.max_words = max_words
        self._reset()
        m = self.model
        raw = [b"" if i in m.special else bytes([m.byte_of[i]]) if i in m.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(m.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

    def split(self, text: str) -> list[str]:
        if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or SPACE in text:
            # Runs of spaces belong to the word behind them: such words are noted with their spaces.
            return ["\n" + w for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def _numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        get, numbers, counts = self.index.__getitem__, [], []
        for text in texts:
            before = len(numbers)
            numbers.extend(map(get, self.split(text) if text else ()))
            counts.append(len(numbers) - before)
        return np.array(numbers, np.int64), np.array(counts, np.int64)

    def segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [(w[1:] if w[1:2] == SPACE else w) if w[:1] == "\n" else SPACE + w for w in words]
        return self.model.segment(whole)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of ids laid end to end: byte pieces become characters, the leading space goes, controls vanish."""
        ids = ids.astype(np.int64)
        sizes = self.raw_size[ids]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.raw_start[ids] - (ends - sizes), sizes)
        raw, cut = self.raw[take].tobytes(), np.concatenate([[0], ends])[at].tolist()
        out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in out]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ids (array<int>) of text; null and empty texts have none. Other columns stay as they are."""
    rest = [c for c in docs.columns if c != "ids"]
    docs = docs.select(*rest).withColumn("__text", F.col("text").cast("string"))
    schema = docs.select(*rest).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column(len(rest))
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(texts), 0))):
                ids, cut = c.encode(texts.slice(a, b - a).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns[: len(rest)]), lists], [*rest, "ids"])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (with ids) with text decoded from ids; a null list gives the empty text."""
    rest = [c for c in rows.columns if c != "text"]
    schema = rows.select(*rest).schema.add("text", "string")
    at = rest.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(at)), 0)).astype(np.int64)
            for a, b in slices(sizes, 1 << 19):
                rows_ids = [x or [] for x in batch.column(at).slice(a, b - a).to_pylist()]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in rows_ids])]).astype(np.int64)
                text = c.decode(np.array([i for x in rows_ids for i in x], np.int64), cut)
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in batch.columns), pa.array(text, pa.string())], [*rest, "text"])

    return rows.select(*rest).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian uint32), n_chars and exact: whether decoding gives the text back.

    Encodes and decodes in one pass, so that ids need not leave the task. Null counts as empty. Rows that repeat
    give their rows each; an empty table gives none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        c = codec(path)
        for batch in batches:
            for a, b in slices(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0))):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, at = c.encode(texts)
                back, raw = c.decode(ids, at), memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([x == y for x, y in zip(texts, back, strict=True)])], ["doc_id", "n_ids", "ids_crc32", "n_chars", "exact"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, exact boolean")
