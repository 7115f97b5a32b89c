"""Operator 7, suffix-array dedup: a common-prefix-aware distributed merge sort of sparse suffixes.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a smaller doc_id.

Only suffixes at anchors are sorted: of every ``LENGTH`` bytes, the positions whose ``GRAM`` bytes have the
least hash. Equal strings have their anchors at equal places, so comparing anchors and what stands around
them loses no match (winnowing). The steps:

1. Texts are dealt out by their SHA-256; a task sends each text once. Equal texts become one, with their smallest
   doc_id, in segments (some MB of whole texts): a copy with a larger doc_id is covered from end to end, so it
   takes no further part. The segments are written once, bucketed by their numbers, so that steps 3 and 5 don't
   shuffle their texts again.
2. Each segment sends the hashes of its anchors' grams with their numbers of documents to the owners of hash
   ranges; these answer, in the same order, which grams lie in more than one document. All other anchors are
   out. (Hashes are cut to 48 bits: a filter may only let too much through.) What is sent is a row for each owner
   that has a gram of the segment, so never more rows than grams.
3. Each segment sorts the suffixes at its remaining anchors: LENGTH bytes to the right, then the bytes to the
   left in reverse. Of equal ones only the smallest doc_id goes on: the others are already decided. The
   sorted run goes to the owner of the gram, front-coded (bytes shared with the suffix before are left out).
4. The owner merges the runs of all segments with a loser tree that keeps, for each loser, the length of the
   prefix it shares with the winner: different lengths decide without a look at the bytes, and equal ones go
   on comparing behind that prefix. The merged order comes out with its own shared-prefix lengths, from which
   (and those of the left sides) the windows that are equal at each distance from the anchor are read off;
   each group's smallest doc_id decides. A gram of more than ``HOT`` documents is dealt out window by window
   instead, by the windows' hashes, so that one common passage cannot fill one task.
5. The answers, a bit for each window, go back to the segments, which cut out the bytes.

Everything but the equality of whole texts is decided by bytes, not by hashes. A segment sends equal suffixes
once, so copies and common passages are combined before any shuffle.

Results for odd rows: a null text counts as empty. A null doc_id is smaller than any other. Rows that share
a doc_id take nothing from each other. Texts under LENGTH bytes stay whole. A very long text is a segment of its
own, whose anchors are found block by block. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import _bytes
from foliant.llm._segments import packed_counts, unpacked_counts
from foliant.llm._tables import bucketed, documents, text_bytes

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # grams of a window
LEFT = SPAN - 1
WIDTH = LENGTH + LEFT
SEGMENT_BYTES = 2 << 20
OWNER_BYTES = 8 << 20
#: Text bytes of a bucket of segments, which is what a task reads.
BUCKET_BYTES = 32 << 20
#: Spark's limit; beyond it a bucket has more segments, which a task reads one after the other.
MOST_BUCKETS = 100_000
HOT = 200_000
#: Bytes in which anchors are looked for at a time.
BLOCK = 1 << 18
_NULL = -(2**63)
_CUT = np.uint64(16)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each position, 1 at least."""
    return np.maximum(_bytes.run_hashes(data, size), np.uint64(1))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by minima from both sides of blocks of w."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = h
    block = padded.reshape(-1, w)
    forward = np.minimum.accumulate(block, axis=1).ravel()
    backward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors, and their grams' hashes, by blocks: an anchor depends on the bytes within LENGTH
    of its gram. A window that crosses the end of a text has none."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a in range(0, max(0, len(data) - GRAM + 1), BLOCK):
        b = min(len(data), a + BLOCK)
        low, high = max(0, a - LENGTH), min(len(data), b + 2 * LENGTH)
        if high - low >= LENGTH:
            spots, h = _block_anchors(data[low:high], offsets[np.searchsorted(offsets, low, "right") : np.searchsorted(offsets, high)] - low)
            own = (spots + low >= a) & (spots + low < b)
            found.append((spots[own] + low, h[own]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block_anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = _hashes(data, GRAM)
    least = _least(h, SPAN)
    whole = np.ones(len(least), dtype=bool)
    for end in ends.tolist():
        whole[max(0, end - LENGTH + 1) : end] = False
    least[~whole] = 0
    # an anchor's hash is the largest of the minima of all windows that hold it
    wide = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    spots = np.flatnonzero(~_least(~wide, SPAN) == h)
    return spots, h[spots]


class Segment:
    """A row of the stored segments, opened."""

    def __init__(self, row: dict):
        self.ids = np.array([_NULL if x is None else x for x in row["doc_ids"]], dtype=np.int64)
        self.data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
        self.spots, self.hashes = anchors(self.data, self.offsets)
        self.text = np.searchsorted(self.offsets, self.spots, "right") - 1
        # anchors have small hashes by their choice; mixed once more they spread evenly over the owners
        self.grams, self.gram_of = np.unique(_bytes.mixed(self.hashes) >> _CUT, return_inverse=True)

    def owners(self, bits: int) -> np.ndarray:
        """The owner of each gram: they share the 48 bits evenly."""
        return (self.grams >> np.uint64(48 - bits)).astype(np.int64)


TEXTS = "bk long, digest binary, doc_id long, text binary"
SEGMENTS = "segment long, doc_ids array<long>, sizes binary, digests binary, data binary"


def _combine_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text of the task once; of its later copies the doc_id alone, where it is smaller than all before."""
    seen: dict[bytes, int] = {}
    for batch in batches:
        data, offsets = _bytes.flat(batch.column(1))
        rows: list[tuple] = []
        for i, (a, b) in zip(batch.column(0).to_pylist(), zip(offsets.tolist(), offsets[1:].tolist(), strict=False), strict=True):
            text = data[a:b].tobytes()
            digest, number = hashlib.sha256(text).digest(), _NULL if i is None else i
            known = seen.get(digest)
            if known is None or number < known:
                seen[digest] = number
                rows.append((int.from_bytes(digest[:8], "big", signed=True), digest, i, zstandard.compress(text, 1) if known is None else None))
        yield _table(rows, ("bk", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("text", pa.binary()))


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, columns, strict=True)], names=[n for n, _ in columns])


def _segment_task(most: int):
    """Rows come in the order of bk, digest and doc_id. A segment's number is the bk of its first text, so it lies
    in the same bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # [bk, digest, doc_id, text] of each text
        size = 0

        def full() -> pa.RecordBatch:
            texts = [x[3] for x in held]
            row = (held[0][0], [x[2] for x in held], np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(x[1] for x in held), zstandard.compress(b"".join(texts), 1))
            return _table([row], ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("digests", pa.binary()), ("data", pa.binary()))

        for batch in batches:
            for bk, digest, doc_id, text in zip(*(batch.column(k) for k in range(4)), strict=True):
                digest = digest.as_py()
                if not held or held[-1][1] != digest:
                    if size >= most and held[-1][3] is not None and held[-1][0] != bk.as_py():
                        yield full()
                        held, size = [], 0
                    held.append([bk.as_py(), digest, doc_id.as_py(), None])
                if held[-1][3] is None and text.is_valid:
                    held[-1][3] = zstandard.decompress(text.as_py())
                    size += len(held[-1][3])
        if held:
            yield full()

    return run


def _planes48(sorted_words: np.ndarray) -> bytes:
    gaps = np.diff(sorted_words, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes(), 1)


def _from_planes48(raw: bytes) -> np.ndarray:
    few = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(6, -1).T
    wide = np.zeros((len(few), 8), np.uint8)
    wide[:, :6] = few
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _by_owner(owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, first, last + 1) of the runs of an ascending array."""
    cut = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else np.zeros(0, int)
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cut, cut[1:], strict=False)]


def _gram_task(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                pairs = np.unique(s.gram_of * np.int64(len(s.ids) + 1) + s.text) // (len(s.ids) + 1)
                n = np.bincount(pairs, minlength=len(s.grams))
                rows = [(o, row["segment"], _planes48(s.grams[a:b]), packed_counts(n[a:b])) for o, a, b in _by_owner(s.owners(bits))]
                yield _table(rows, ("owner", pa.int64()), ("segment", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary()))

    return run


def _repeat_task(hot: int):
    """For each gram that a segment sent: 0 for one document, 1 for more, 2 for more than ``hot``."""

    def run(rows: pa.Table) -> pa.Table:
        grams = [_from_planes48(x.as_py()) for x in rows.column("grams")]
        counts = np.concatenate([unpacked_counts(x.as_py()) for x in rows.column("counts")])
        unique, back = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.bincount(back, weights=counts, minlength=len(unique))
        kind = ((total > 1).astype(np.uint8) + (total > hot))[back]
        parts = np.split(kind, np.cumsum([len(g) for g in grams])[:-1])
        return pa.table({"segment": rows.column("segment"), "owner": rows.column("owner"), "answer": pa.array([zstandard.compress(x.tobytes(), 1) for x in parts], pa.binary())})

    return run


def _contexts(s: Segment, spots: np.ndarray, text: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix at each spot followed by up to ``left`` bytes before it in reverse, padded with zeros; and how
    many bytes of either side are in the text."""
    right_n = np.minimum(LENGTH, s.offsets[text + 1] - spots)
    left_n = np.minimum(left, spots - s.offsets[text])
    out = np.zeros((len(spots), WIDTH), np.uint8)
    wide = np.concatenate([np.zeros(LEFT, np.uint8), s.data, np.zeros(LENGTH, np.uint8)])
    for k in range(LENGTH):
        out[:, k] = np.where(k < right_n, wide[spots + LEFT + k], 0)
    for k in range(left):
        out[:, LENGTH + k] = np.where(k < left_n, wide[spots + LEFT - 1 - k], 0)
    return out, right_n, left_n


def _shared(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before; 0 for the first."""
    if not len(rows):
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])])


def _order(rows: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


_SENT = ["kind", "segment", "owner", "blob"]
SENT = "kind int, segment long, owner long, blob binary"


def _front_coded(rows: np.ndarray, shared: np.ndarray) -> bytes:
    keep = np.arange(rows.shape[1])[None, :] >= shared[:, None]
    return rows[keep].tobytes()


def _blob(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.compress(sizes + b"".join(parts), 1)


def _parts(raw: bytes) -> list[bytes]:
    whole = zstandard.decompress(raw)
    n = int(np.frombuffer(whole, "<u4", 1)[0])
    at = np.concatenate([[4 + 4 * n], 4 + 4 * n + np.cumsum(np.frombuffer(whole, "<u4", n, 4).astype(np.int64))]).tolist()
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def _planes64(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _run_task(bits: int):
    """kind 0: a front-coded sorted run for an owner. kind 1: what the segment itself must know of its runs,
    spots of each item, and the byte ranges that it could decide alone; it passes the merge in a group of its own
    (a negative owner) untouched."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        for row in left.to_pylist():
            s = Segment(row)
            answers = sorted(right.select(["owner", "answer"]).to_pylist(), key=lambda r: r["owner"])
            kind = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zstandard.decompress(r["answer"]), np.uint8) for r in answers)])[s.gram_of]
            plain, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            spots, text, owner = [s.spots[plain]], [s.text[plain]], [s.owners(bits)[s.gram_of[plain]]]
            rows, right_n, left_n = map(list, zip(_contexts(s, s.spots[plain], s.text[plain], LEFT), strict=True))
            if len(hot):  # every window around the anchor on its own
                starts = (s.spots[hot][:, None] - np.arange(LEFT + 1)[None, :]).ravel()
                owners = np.repeat(s.text[hot], LEFT + 1)
                own = (starts >= s.offsets[owners]) & (starts + LENGTH <= s.offsets[owners + 1])
                starts, first = np.unique(starts[own], return_index=True)
                spots.append(starts)
                text.append(owners[own][first])
                owner.append((1 << bits) + (_hashes(s.data, LENGTH)[starts] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.full(len(starts), 1))
                for x, y in zip((rows, right_n, left_n), _contexts(s, spots[-1], text[-1], 0), strict=True):
                    x.append(y)
            spots, text, owner, rows, right_n, left_n = map(np.concatenate, (spots, text, owner, rows, right_n, left_n))
            own = np.flatnonzero(right_n + left_n >= LENGTH)
            ids = s.ids[text]
            # by owner, then suffix, then how far it reaches, then document
            place = own[_order(rows[own])] if len(own) else own
            place = place[np.argsort(owner[place], kind="stable")]
            same = np.concatenate([[False], (_shared(rows[place])[1:] == WIDTH) & (owner[place][1:] == owner[place][:-1])]) if len(place) else np.zeros(0, bool)
            group = np.cumsum(~same) - 1
            tie = np.lexsort((spots[place], ids[place], left_n[place], right_n[place], group))
            place, group = place[tie], group[tie]
            new = np.ones(len(place), dtype=bool)
            new[1:] = (group[1:] != group[:-1]) | (right_n[place][1:] != right_n[place][:-1]) | (left_n[place][1:] != left_n[place][:-1])
            item = np.cumsum(new) - 1
            head = place[new]
            least = ids[head][item] if len(head) else ids[:0]
            later = ids[place] > least
            cut_a = spots[place][later] - left_n[place][later]
            cut_b = spots[place][later] + right_n[place][later]
            mine = ~later
            for o, a, b in _by_owner(owner[head]):
                some = head[a:b]
                shared = _shared(rows[some])
                found.append((0, row["segment"], o, _blob(shared.astype(np.uint8).tobytes(), _front_coded(rows[some], shared), _planes64(ids[some]), right_n[some].astype(np.uint8).tobytes(), left_n[some].astype(np.uint8).tobytes(), np.array([a], "<u4").tobytes())))
            by_spot = np.argsort(spots[place][mine], kind="stable")
            parts = np.diff(spots[place][mine][by_spot], prepend=0), item[mine][by_spot], cut_a, cut_b - cut_a
            found.append((1, row["segment"], -1 - (row["segment"] & (2**62 - 1)), _blob(*(_planes64(x) for x in parts))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_SENT)

    return run


class LoserTree:
    """Merges sorted runs of byte strings of one length. Each run comes with the lengths of the prefix that
    every string shares with the one before it. ``merged`` yields (run, shared): whose next string is the
    least, and the length of the prefix it shares with the string yielded before."""

    def __init__(self, runs: list[list[bytes]], shared: list[list[int]], width: int):
        self.runs, self.shared, self.width = runs, shared, width
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.at = [0] * self.k
        self.size = [len(r) for r in runs] + [0] * (self.k - len(runs))
        self.loser = [0] * self.k  # by node: the run that lost there
        self.lcp = [0] * self.k  # by node: what it shares with the winner

    def _beats(self, a: int, b: int, known: int) -> tuple[bool, int]:
        """Whether run a's next string comes before run b's, and what the two share; known: a length up to
        which they are known to be equal, not looked at again."""
        if self.at[a] >= self.size[a]:
            return False, 0
        if self.at[b] >= self.size[b]:
            return True, 0
        x, y = self.runs[a][self.at[a]][known:], self.runs[b][self.at[b]][known:]
        if x == y:
            return a < b, self.width
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        return x < y, self.width - (differ.bit_length() + 7) // 8

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        first, self.lcp[node] = self._beats(a, b, 0)
        self.loser[node] = b if first else a
        return a if first else b

    def merged(self) -> Iterator[tuple[int, int]]:
        at, size, loser, lcp, shared, k = self.at, self.size, self.loser, self.lcp, self.shared, self.k
        winner, own = (self._build(1), 0) if k > 1 else (0, 0)
        for _ in range(sum(size)):
            yield winner, own
            at[winner] += 1
            live = at[winner] < size[winner]
            own = shared[winner][at[winner]] if live else -1
            node = (winner + k) >> 1
            while node:
                other, known = loser[node], lcp[node]
                if at[other] >= size[other]:
                    known = -1
                if known > own:  # the loser shares more with the last string, so it comes first
                    loser[node], lcp[node] = winner, max(own, 0)
                    winner, own = other, known
                elif known == own and own >= 0:
                    first, common = self._beats(winner, other, own)
                    lcp[node] = common
                    if not first:
                        loser[node], winner = winner, other
                node >>= 1


def _decoded(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    shared, rest, ids, right_n, left_n, at = _parts(raw)
    shared = np.frombuffer(shared, np.uint8).astype(np.int64)
    rows = np.zeros((len(shared), WIDTH), np.uint8)
    keep = np.arange(WIDTH)[None, :] >= shared[:, None]
    rows[keep] = np.frombuffer(rest, np.uint8)
    # a byte that was left out is the last one written above it
    source = np.maximum.accumulate(np.where(keep, np.arange(len(rows))[:, None], 0), axis=0)
    rows = np.take_along_axis(rows, source, axis=0)
    items = np.arange(len(shared), dtype="<u4") + np.frombuffer(at, "<u4")[0]
    return rows, shared, _from_planes64(ids), np.frombuffer(right_n, np.uint8).astype(np.int64), np.frombuffer(left_n, np.uint8).astype(np.int64), items


def _merge_task(rows: pa.Table) -> pa.Table:
    """For each segment: its items whose windows start in smaller documents too, a bit for each distance of
    the window's start before the anchor."""
    if rows.num_rows and rows.column("owner")[0].as_py() < 0:
        return rows.select(_SENT)
    runs = [_decoded(x.as_py()) for x in rows.column("blob")]
    strings = [[raw[a : a + WIDTH] for a in range(0, len(raw), WIDTH)] for raw in (r[0].tobytes() for r in runs)]
    tree = LoserTree(strings, [r[1].tolist() for r in runs], WIDTH)
    total = sum(map(len, strings))
    whose, shared = np.zeros(total, np.int64), np.zeros(total, np.int64)
    for i, (run, own) in enumerate(tree.merged()):
        whose[i], shared[i] = run, own
    begin = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    by_run = np.argsort(whose, kind="stable")
    source = np.empty(total, np.int64)  # each run's strings come in their order
    source[by_run] = np.arange(total)
    whole, ids, right_n, left_n = (np.concatenate([r[j] for r in runs])[source] for j in (0, 2, 3, 4))
    lefts = whole[:, LENGTH:]
    left_order = _order(lefts) if total else np.zeros(0, int)
    left_shared = _shared(lefts[left_order])
    mask = np.zeros(total, np.uint32)
    for d in range(LEFT + 1):
        own = np.flatnonzero((left_n >= d) & (right_n >= LENGTH - d))
        if not len(own):
            continue
        right_group = np.cumsum(shared < LENGTH - d)
        left_group = np.empty(total, np.int64)
        left_group[left_order] = np.cumsum(left_shared < d)
        code = right_group[own] * np.int64(total + 1) + left_group[own]
        order = np.lexsort((ids[own], code))
        code, who = code[order], own[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])
        least = ids[who][np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))]
        mask[who[ids[who] > least]] |= np.uint32(1 << d)
    back = np.zeros(total, np.uint32)
    back[source] = mask
    found = []
    for i, r in enumerate(runs):
        own = back[begin[i] : begin[i + 1]]
        some = np.flatnonzero(own)
        if len(some):
            found.append((2, rows.column("segment")[i].as_py(), 0, _blob(r[5][some].tobytes(), own[some].tobytes())))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=_SENT)


def _removed(size: int, known: pa.Table) -> np.ndarray:
    """Which bytes of the segment go."""
    step = np.zeros(size + 1, dtype=np.int64)
    answers = known.select(["kind", "blob"]).to_pylist()
    masks = [_parts(r["blob"]) for r in answers if r["kind"] == 2]
    for r in answers:
        if r["kind"] != 1:
            continue
        spots, item, a, n = map(_from_planes64, _parts(r["blob"]))
        np.add.at(step, a, 1)
        np.add.at(step, a + n, -1)
        spots = np.cumsum(spots)
        mask = np.zeros(int(item.max(initial=-1)) + 1, np.uint32)
        for items, bits in masks:
            mask[np.frombuffer(items, "<u4")] = np.frombuffer(bits, "<u4")
        mine = mask[item]
        for d in range(LEFT + 1):
            start = spots[(mine >> np.uint32(d)) & 1 > 0] - d
            np.add.at(step, start, 1)
            np.add.at(step, start + LENGTH, -1)
    return np.cumsum(step[:-1]) > 0


CUT = "digest string, lead long, n_removed long, n_spans long, kept_sha256 string"


def _cutting_task(with_text: bool):
    columns = [("digest", pa.string()), ("lead", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *[("kept", pa.binary())] * with_text]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            data = np.frombuffer(zstandard.decompress(row["data"]), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))])
            gone = _removed(len(data), right)
            kept = data[~gone].tobytes()
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(gone)]
            begin[cuts] = gone[cuts]  # a run never crosses texts
            before, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begin))
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist(), strict=False)):
                n, text, digest = int(before[b] - before[a]), kept[a - int(before[a]) : b - int(before[b])], row["digests"][32 * i : 32 * i + 32].hex()
                out = (digest, row["doc_ids"][i], n, int(spans[b] - spans[a]), hashlib.sha256(text).hexdigest() if n else digest)
                found.append((*out, text) if with_text else out)
        return pa.Table.from_batches([_table(found, *columns)])

    return run


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of each row."""
    size = text_bytes(docs)
    bits = max(0, int(np.ceil(np.log2(max(1, size / OWNER_BYTES)))))
    buckets = min(MOST_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    dealt = docs.select("doc_id", "text").mapInArrow(_combine_task, TEXTS).repartition(buckets, "bk").sortWithinPartitions("bk", "digest", "doc_id")
    segments = bucketed(dealt.mapInArrow(_segment_task(SEGMENT_BYTES), SEGMENTS), "segments", "segment", buckets)
    grams = segments.mapInArrow(_gram_task(bits), "owner long, segment long, grams binary, counts binary")
    answers = grams.groupBy("owner").applyInArrow(_repeat_task(HOT), "segment long, owner long, answer binary")
    sent = segments.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(_run_task(bits), SENT)
    known = sent.groupBy("owner").applyInArrow(_merge_task, SENT)
    cut = segments.groupBy("segment").cogroup(known.groupBy("segment")).applyInArrow(_cutting_task(with_text), CUT + (", kept binary" if with_text else ""))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"), *([text.alias("bytes")] if with_text else []))
    joined = rows.join(cut, (F.col("own") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("lead")), "left")
    # a row that leads no group of equal texts is a copy: all of it goes, unless it is too short to hold a string
    first, gone = F.col("digest").isNotNull(), F.col("n_bytes") >= LENGTH
    pick = lambda c, all_, none: F.when(first, F.col(c)).when(gone, all_).otherwise(none).alias(c)
    results = [pick("n_removed", F.col("n_bytes"), F.lit(0)), pick("n_spans", F.lit(1), F.lit(0)), pick("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("own"))]
    return joined.select("doc_id", "n_bytes", *results, *([pick("kept", F.lit(b""), F.col("bytes"))] if with_text else []))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
