"""SentencePiece encoding and decoding by batched numpy merges (BPE models) or Viterbi (unigram models).

A text gets a leading space and is cut where a run of spaces begins (U+2581 counts as a space); no piece reaches over
such a cut. Segments are found and looked up by hash over whole columns; those new to a task are grouped by length, and
all segments of one length advance together.
In a BPE model each round merges the best-scored adjacent pair of every row, the leftmost of equal ones, until no
pair is a piece; a row of more than MERGE_CHARS characters takes its pairs from a heap in the same order. In a
unigram model the maxima of the path scores leave backpointers. Both probe the sorted hashes of the vocabulary.
Characters that no piece covers become byte pieces. Decoding joins the pieces' bytes.

The ids are those of the library's encode for the same model.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from wardlight.llm.textkernel import mix, span_hashes, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bounds on what a task holds: text and ids taken together, remembered segments, cells of a batch of segments.
GROUP_BYTES, GROUP_IDS, CACHE_SEGMENTS, CACHE_BYTES, CELLS = 512 << 10, 1 << 18, 100_000, 4 << 20, 1 << 17
MERGE_CHARS = 256


def _hash(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points, one column more than codes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + (codes[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


@dataclass
class Vocabulary:
    """Pieces by id: sorted substring hashes for probing, scores, and bytes for decoding."""

    keys: np.ndarray
    key_ids: np.ndarray
    scores: np.ndarray
    longest: int
    byte_ids: np.ndarray
    unknown: float
    bytes_of: np.ndarray
    bytes_at: np.ndarray
    bpe: bool

    @classmethod
    def load(cls, path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        bad = [p for i in normal if "▁" in (p := pieces[i]).lstrip("▁")]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces, which split again after a merge, are not handled")
        if bad or any(not sp.is_byte(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("a model with byte fallback and leading spaces is needed")
        hashes = np.array([_hash(np.array([[ord(c) for c in pieces[i]]]))[0, -1] for i in normal], np.uint64)
        order = np.argsort(hashes)
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [b""] * n
        for i in normal:
            raw[i] = pieces[i].replace("▁", " ").encode()
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        scores = np.array([sp.get_score(i) for i in normal])
        return cls(
            hashes[order], np.array(normal, np.int32)[order], scores[order], max(len(pieces[i]) for i in normal), byte_ids, float(scores.min()) - 10.0,
            np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]),
            bool((scores == np.round(scores)).all()),  # merge ranks, not log probabilities
        )

    @functools.cached_property
    def score_of(self) -> dict[int, float]:
        return dict(zip(self.keys.tolist(), self.scores.tolist()))

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the rows of code points, and how many each has; all rows have one length and advance together."""
        n, length = codes.shape
        h = _hash(codes)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        step = np.ones((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1, np.int32)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]))
        for end in range(1, length + 1):
            for size in range(min(self.longest, end), 0, -1):  # of equal paths the longest last piece wins
                sub = h[:, end] - h[:, end - size] * power[size]
                at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
                hit = self.keys[at] == sub
                score = np.where(hit, best[:, end - size] + self.scores[at], -np.inf)
                if size == 1:
                    score = np.where(hit, score, best[:, end - 1] + self.unknown)
                better = score > best[:, end]
                best[better, end] = score[better]
                step[better, end] = size
                piece[better, end] = np.where(hit[better], self.key_ids[at[better]], -1)
        return _flat([self._walk(codes[r], step[r], piece[r]) for r in range(n)])

    def _walk(self, codes: np.ndarray, step: np.ndarray, piece: np.ndarray) -> np.ndarray:
        out, at = [], len(codes)
        while at:
            if piece[at] >= 0:
                out.append(int(piece[at]))
            else:
                out += [int(self.byte_ids[b]) for b in reversed(chr(codes[at - 1]).encode())]
            at -= int(step[at])
        return np.array(out[::-1], np.int32)

    def _find(self, h: np.ndarray, power: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (-inf where the span is no piece) and ids (-1 there) of spans of the rows."""
        size = end - start
        sub = h[rows, end] - h[rows, start] * power[np.minimum(size, self.longest)]
        at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
        hit = (self.keys[at] == sub) & (size <= self.longest)
        return np.where(hit, self.scores[at], -np.inf), np.where(hit, self.key_ids[at], -1)

    def _spans(self, codes: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i, at in zip(ids.tolist(), start.tolist()):  # only single characters are no piece
            out += [i] if i >= 0 else [int(self.byte_ids[b]) for b in chr(codes[at]).encode()]
        return np.array(out, np.int32)

    def merge(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by merges; a row in work loses one boundary a round, so all keep one width."""
        n, length = codes.shape
        h = _hash(codes)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, BASE)]))
        if length > MERGE_CHARS:
            return _flat([self._merge_long(codes[r], h[r : r + 1], power) for r in range(n)])
        counts, done = np.zeros(n, np.int64), []
        live, width = np.arange(n), length
        bound = np.tile(np.arange(length + 1), (n, 1))
        score = self._find(h, power, live[:, None], bound[:, :-2], bound[:, 2:])[0]
        while len(live):
            best = score.argmax(1) if width > 1 else np.zeros(len(live), int)
            more = score[np.arange(len(live)), best] > -np.inf if width > 1 else np.zeros(len(live), bool)
            if not more.all():
                rows, ends = live[~more], bound[~more]
                ids = self._find(h, power, rows[:, None], ends[:, :-1], ends[:, 1:])[1]
                plain = (ids >= 0).all(axis=1)
                counts[rows[plain]] = width
                done.append((rows[plain], ids[plain].ravel()))
                for r, i, e in zip(rows[~plain], ids[~plain], ends[~plain]):
                    one = self._spans(codes[r], i, e)
                    counts[r] = len(one)
                    done.append((np.array([r]), one))
                live, bound, score, best = live[more], bound[more], score[more], best[more]
            if not len(live):
                break
            k = np.arange(len(live))
            keep = np.ones(bound.shape, bool)
            keep[k, best + 1] = False
            bound = bound[keep].reshape(len(live), width)
            keep = np.ones(score.shape, bool)
            keep[k, best] = False
            width -= 1
            score = score[keep].reshape(len(live), width - 1)
            for at in (best - 1, best):  # the pairs on both sides of the new piece
                ok = (at >= 0) & (at < width - 1)
                r, c = k[ok], at[ok]
                score[r, c] = self._find(h, power, live[r], bound[r, c], bound[r, c + 2])[0]
        return _placed(counts, done), counts

    def _merge_long(self, codes: np.ndarray, h: np.ndarray, power: np.ndarray) -> np.ndarray:
        """The same merges for one long row, in the order of a heap of pairs."""
        n = len(codes)
        at = np.arange(n - 1)
        score = self._find(h, power, np.zeros(n - 1, int), at, at + 2)[0]
        heap = [(-s, i, i + 1, i + 2) for i, s in enumerate(score.tolist()) if s > -np.inf]
        heapq.heapify(heap)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # a piece's end by start, its left one's start by start
        hashes, powers, mask = h[0].tolist(), power.tolist(), (1 << 64) - 1
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if before[i] is None or end[i] != mid or mid == n or end[mid] != stop or before[mid] is None:
                continue
            end[i], before[mid] = stop, None
            if stop < n:
                before[stop] = i
            for left, right in ((before[i], i), (i, stop)):
                if left < 0 or right >= n or end[right] - left > self.longest:
                    continue
                found = self.score_of.get((hashes[end[right]] - hashes[left] * powers[end[right] - left]) & mask)
                if found is not None:
                    heapq.heappush(heap, (-found, left, right, end[right]))
        start = np.array([i for i in range(n) if before[i] is not None])
        stops = np.array([*start[1:], n])
        return self._spans(codes, self._find(h, power, np.zeros(len(start), int), start, stops)[1], start)

    def encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the segments by the model's own method, and how many each has."""
        return self._by_length(segments, self.merge if self.bpe else self.viterbi)

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the highest score sum, as a unigram model needs them."""
        return self._by_length(segments, self.viterbi)

    def _by_length(self, segments: list[str], method) -> tuple[np.ndarray, np.ndarray]:
        lengths, counts, done = np.array([len(s) for s in segments]), np.zeros(len(segments), np.int64), []
        for length in np.unique(lengths):
            rows = np.flatnonzero(lengths == length)
            for part in np.array_split(rows, max(1, len(rows) * (int(length) + 1) // CELLS)):
                codes = np.frombuffer("".join(segments[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                ids, counts[part] = method(codes)
                done.append((part, ids))
        return _placed(counts, done), counts


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows), np.array([len(x) for x in rows])


def _placed(counts: np.ndarray, done: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Flat ids in row order from (rows, their flat ids)."""
    begin, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.int32)
    for rows, ids in done:
        n = counts[rows]
        out[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Encodes texts in Arrow columns, remembering segments up to a bound on their number and bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of segments, and which they are
        self.ids, self.at, self.bytes = np.zeros(0, np.int32), np.zeros(1, np.int64), 0

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, opening: np.ndarray) -> None:
        """Encodes the distinct new segments and remembers them."""
        new, first = np.unique(hashes, return_index=True)
        raw = data.tobytes()
        segments = [" " * bool(opening[i]) + raw[starts[i] : ends[i]].decode() for i in first]
        made, counts = self.vocabulary.encode([x.replace(" ", "▁") for x in segments])
        where = np.searchsorted(self.known, new)
        self.known = np.insert(self.known, where, new)
        self.place = np.insert(self.place, where, np.arange(len(self.at) - 1, len(self.at) - 1 + len(new)))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, made])
        self.bytes += sum(map(len, segments))

    def _codes(self, hashes: np.ndarray) -> np.ndarray:
        """Which remembered segment each hash is, -1 for none."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.place[at], -1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of consecutive texts (UTF-8, U+2581 as a space), and how many each has."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        opens = np.zeros(len(data) + 1, bool)
        opens[offsets] = True
        begins = data == 0x20
        begins[1:] &= ~begins[:-1]
        begins |= opens[:-1]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        opening = opens[starts]
        hashes = mix(span_hashes(data, starts, ends)[0] + opening.astype(np.uint64), 5) ^ (ends - starts).astype(np.uint64)
        if len(self.known) > CACHE_SEGMENTS or self.bytes > CACHE_BYTES:
            self._clear()
        codes = self._codes(hashes)
        if (missing := np.flatnonzero(codes < 0)).size:
            self._learn(hashes[missing], data, starts[missing], ends[missing], opening[missing])
            codes[missing] = self._codes(hashes[missing])
        lengths = np.diff(self.at)[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        first = np.searchsorted(starts, offsets)
        return _gather(self.ids, self.at[codes], lengths), np.diff(total[first])


def _decoded(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of consecutive lists of ids, and offsets; the leading space of each text is left out."""
    size = np.diff(v.bytes_at)[ids]
    data = _gather(v.bytes_of, v.bytes_at[ids], size)
    offsets = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    keep = np.ones(len(data), bool)
    heads = offsets[:-1][np.diff(offsets) > 0]
    keep[heads[data[heads] == 0x20]] = False
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def _spaced(column: pa.Array) -> pa.Array:
    """Texts with U+2581 as a space and null as empty, as the model reads them."""
    column = column.fill_null("") if column.null_count else column
    return pc.replace_substring(column, "▁", " ") if pc.any(pc.match_substring(column, "▁")).as_py() else column


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", out_col: str = "ids", check_col: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs plus the piece ids of each whole text; with check_col also whether they decode to it, U+2581 counting as a space.

    Null and empty texts have no ids and decode to the empty text. Columns named out_col or check_col are replaced; of the
    others all pass through, or those in carry only. Rows are encoded one by one, so repeated rows get equal ids; of equally
    scored merges the leftmost goes first, and of equal unigram paths the one with the longest last piece. Texts are taken in
    groups of GROUP_BYTES, a longer text alone. An empty table gives an empty result.
    """
    made = [out_col, *([check_col] if check_col else [])]
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))  # the vocabulary file's size
    text_at, kept_at = docs.columns.index(text_col), [docs.columns.index(c) for c in carry]
    fields = [StructField(out_col, ArrayType(IntegerType())), *([StructField(check_col, BooleanType())] if check_col else [])]

    def run(batches):
        v, encoder = shared.value, Encoder(shared.value)
        for b in batches:
            for first, end, data, offsets in text_chunks(_spaced(b.column(text_at)), GROUP_BYTES):
                ids, counts = encoder(data, offsets)
                columns = [b.column(i).slice(first, end - first) for i in kept_at] + [_lists(ids, counts)]
                if check_col:
                    back, at = _decoded(v, ids, counts)
                    same = np.diff(at) == np.diff(offsets)
                    raw, text = back.tobytes(), data[offsets[0] : offsets[-1]].tobytes()
                    base = offsets - offsets[0]
                    for i in np.flatnonzero(same):
                        same[i] = raw[at[i] : at[i + 1]] == text[base[i] : base[i + 1]]
                    columns.append(pa.array(same))
                yield pa.RecordBatch.from_arrays(columns, names=[*carry, *made])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in carry), *fields]))


def decode(docs: DataFrame, model: str = MODEL, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs plus the text of the ids; null ids read as none. Bytes that are no UTF-8 become U+FFFD.

    A column named out_col is replaced, others pass through; repeated rows get equal texts. Rows are taken GROUP_IDS
    ids at a time, a longer list alone. An empty table gives an empty result.
    """
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    names = [*docs.columns, out_col]
    ids_at = names.index(ids_col)

    def run(batches):
        v = shared.value
        for b in batches:
            column = b.column(ids_at).fill_null([]) if b.column(ids_at).null_count else b.column(ids_at)
            offsets = column.offsets.to_numpy()
            values, first = column.values.to_numpy(zero_copy_only=False), 0
            while first < len(column):
                end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_IDS, side="right")) - 1)
                data, at = _decoded(v, values[offsets[first] : offsets[end]], np.diff(offsets[first : end + 1]))
                raw = data.tobytes()
                texts = pa.array([raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, end - first) for c in b.columns), texts], names=names)
                first = end

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out_col, StringType())]))


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    """Every whole text encoded and its ids decoded: doc_id, n_pieces, ids_hash, round_trip (whether they give the text)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, check_col="round_trip", carry=["doc_id"])
    return both.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")
