"""k-mers of whole batches of reads as numbers of two bits a letter, counted before they leave a task, and merged by lots of codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Letters worked on at once, and letters held before they are: a task's memory is some 30 bytes for each of the former.
PIECE, HELD = 1 << 23, 1 << 25
BLOCK = 1 << 15
#: Windows of more letters are dealt as stretches: hardly any comes twice in a piece. Most windows of a stretch.
TALLIED, LONGEST = 15, 255
_OTHER = 4
_LETTER = np.full(256, _OTHER, np.uint8)
_LETTER[np.frombuffer(b"ACGT", np.uint8)] = range(4)
#: Four letters by their eight bits.
_WORDS = np.frombuffer("".join(a + b + c + d for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT").encode(), np.uint8).reshape(256, 4)


def translated(batches: Iterator[pa.RecordBatch], table: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(columns, seq) of batches of (columns, text): bytes of texts by a table, those of number 0 fall out; null: empty."""
    for whole in batches:
        if not len(whole):
            continue
        cuts = np.flatnonzero(np.diff((_ends(whole.column(whole.num_columns - 1))[:-1].astype(np.int64)) // PIECE)) + 1
        for a, z in zip([0, *cuts], [*cuts, len(whole)], strict=True):
            b = whole.slice(a, z - a)
            *columns, text = b.columns
            ends = _ends(text)
            out = table[np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
            kept = out != 0
            left = np.append(0, np.cumsum(kept, dtype=np.int32))[ends - ends[0]].astype(np.int32)
            seq = pa.StringArray.from_buffers(len(b), pa.py_buffer(left), pa.py_buffer(out[kept]))
            yield pa.RecordBatch.from_arrays([*columns, seq], schema=schema)


def _ends(text: pa.Array) -> np.ndarray:
    """Where texts begin and end among their bytes; a null has none."""
    return np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]


def window_codes(letters: np.ndarray, k: int, both_strands: bool = False) -> np.ndarray:
    """Two bits a letter of every window of k letters (0 to 3, other values are no letters), in order; at most 31 letters.

    Windows of a power of two letters come from two of half the length, others
    from those. both_strands: the smaller of the window and its reverse complement.
    """
    n = len(letters) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ones = (letters & 3).astype(np.int64)
    forth, back, size, done = ones, 3 - ones if both_strands else None, 1, 0
    out = turned = np.zeros(len(letters) + 1, np.int64)
    while True:
        if k & size:  # the next letters of each window
            out = (out[: len(forth) - done] << 2 * size) | forth[done:]
            if both_strands:
                turned = (back[done:] << 2 * done) | turned[: len(back) - done]
            done += size
        if done == k:
            break
        forth = (forth[:-size] << 2 * size) | forth[size:]
        if both_strands:
            back = (back[size:] << 2 * size) | back[:-size]
        size *= 2
    out = np.minimum(out[:n], turned[:n]) if both_strands else out[:n]
    bad = letters > 3
    if bad.any():
        before = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
        out = out[before[k:] == before[:-k]]
    return out


def tally(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and how often each comes."""
    if 4**k <= 2 * len(codes):
        n = np.bincount(codes, minlength=4**k)
        found = np.flatnonzero(n)
        return found, n[found]
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    return codes[first], np.diff(np.append(first, len(codes)))


def spelled(codes: np.ndarray, k: int) -> pa.Array:
    """The letters of codes."""
    out = np.empty((len(codes), k), np.uint8)
    for end in range(k, 0, -4):
        n = min(4, end)
        out[:, end - n : end] = _WORDS[codes >> 2 * (k - end) & 255, 4 - n :]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(np.arange(0, (len(codes) + 1) * k, k, dtype=np.int32)[: len(codes) + 1]), pa.py_buffer(out))


def _cut(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values as binary rows that begin at the given places."""
    ends = (np.append(at, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _gathered(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, letters) of batches of (keys, seq): the sequences of a key one after the other, some HELD letters of all keys at a time."""
    held: dict[tuple, list[bytes]] = {}
    size = 0

    def flush() -> Iterator[tuple[tuple, np.ndarray]]:
        for key, texts in held.items():
            yield key, _LETTER[np.frombuffer(b"\n".join(texts), np.uint8)]
        held.clear()

    for b in batches:
        *keys, seq = b.columns
        rows = zip(*(c.to_pylist() for c in keys), strict=True) if keys else [()] * len(b)
        for key, text in zip(rows, seq.cast(pa.binary()).to_pylist(), strict=True):
            if text is None or len(text) < k:
                continue
            held.setdefault(key, []).append(text)
            size += len(text)
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def tallies(batches: Iterator[pa.RecordBatch], k: int, both_strands: bool, lots: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(keys, lot, codes, n) of batches of (keys, seq): different codes and how often each comes, a row a key, PIECE letters and lot of codes."""
    for key, letters in _gathered(batches, k):
        for at in range(0, len(letters) - k + 1, PIECE):
            # blocks stay in the processor's cache
            blocks = range(at, min(at + PIECE, len(letters)), BLOCK)
            codes, n = tally(np.concatenate([window_codes(letters[b : min(b + BLOCK, at + PIECE) + k - 1], k, both_strands) for b in blocks]), k)
            lot = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(lots)).astype(np.uint16)
            order = np.argsort(lot, kind="stable")
            lot = lot[order]
            first = np.flatnonzero(np.append(True, lot[1:] != lot[:-1])[: len(lot)])
            kept = [pa.array([x] * len(first), f.type) for x, f in zip(key, schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lot[first].astype(np.int32)), _cut(codes[order], first), _cut(n[order].astype(np.int32), first)], schema=schema)


def least_words(letters: np.ndarray, k: int) -> np.ndarray:
    """For every window of k letters, in order, the least hash of its words of 16 letters (8 where k is below 24)."""
    word = (letters & 3).astype(np.uint32)
    size = 16 if k >= 24 else 8
    for width in (1, 2, 4, 8)[: size.bit_length() - 1]:
        word = (word[:-width] << np.uint32(2 * width)) | word[width:]
    word = word * np.uint32(0x9E3779B1)
    word = (word ^ (word >> np.uint32(15))) * np.uint32(0x85EBCA77)
    word ^= word >> np.uint32(13)
    span, width = k - size + 1, 1
    while 2 * width <= span:
        word = np.minimum(word[:-width], word[width:])
        width *= 2
    return np.minimum(word[: len(word) - (span - width)], word[span - width :]) if width < span else word


def stretches(batches: Iterator[pa.RecordBatch], k: int, lots: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(keys, lot, letters, n) of batches of (keys, seq), a row a key, PIECE letters and lot: stretches of windows with one least word, which gives the lot.

    Four letters make a byte, n has each stretch's windows. That is a byte or two
    a window, where a code and its count are twelve; equal windows have equal
    words, so they meet in one lot.
    """
    for key, letters in _gathered(batches, k):
        for at in range(0, len(letters) - k + 1, PIECE):
            piece = letters[at : at + PIECE + k - 1]
            blocks = range(0, len(piece) - k + 1, BLOCK)
            word = np.concatenate([least_words(piece[b : b + BLOCK + k - 1], k) for b in blocks])
            before = np.concatenate([[0], np.cumsum(piece > 3, dtype=np.int32)])
            cut = np.empty(len(word) + 1, bool)
            cut[[0, -1]] = True
            np.not_equal(word[1:], word[:-1], out=cut[1:-1])
            whole = before[k:] == before[:-k]
            cut[1:-1] |= whole[1:] != whole[:-1]
            cut = np.flatnonzero(cut)
            first, n = cut[:-1], np.diff(cut)
            first, n = first[whole[first]], n[whole[first]]
            if len(n) and n.max() > LONGEST:
                times = -(-n // LONGEST)
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first = np.repeat(first, times) + part * LONGEST
                n = np.minimum(np.repeat(n, times) - part * LONGEST, LONGEST)
            lot = (word[first] % np.uint32(lots)).astype(np.uint16)
            order = np.argsort(lot, kind="stable")
            lot, first, n = lot[order], first[order], n[order]
            head = np.flatnonzero(np.append(True, lot[1:] != lot[:-1])[: len(lot)])
            if not len(head):
                continue
            # each stretch begins with a new byte
            two = np.append(piece & 3, np.zeros(3, np.uint8))
            four = two[:-3] << 6 | two[1:-2] << 4 | two[2:-1] << 2 | two[3:]
            size = (n + (k + 2)) // 4
            begin = np.cumsum(size) - size
            packed = four.take(np.repeat((first - 4 * begin).astype(np.int32), size) + np.arange(0, 4 * int(size.sum()), 4, dtype=np.int32), mode="clip")
            kept = [pa.array([x] * len(head), f.type) for x, f in zip(key, schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lot[head].astype(np.int32)), _cut(packed, begin[head]), _cut(n.astype(np.uint8), head)], schema=schema)


def stretch_codes(packed: bytes, n: bytes, k: int) -> np.ndarray:
    """The codes of all windows of stretches()' letters."""
    windows = np.frombuffer(n, np.uint8).astype(np.int64)
    size = (windows + (k + 2)) // 4
    eight = np.frombuffer(packed + bytes(8), np.uint8).astype(np.uint64)
    after = eight[8:]
    for width in (1, 2, 4):  # the letters of eight bytes from each byte on
        eight = (eight[:-width] << np.uint64(8 * width)) | eight[width:]
    eight = eight[: len(after)]
    codes = np.empty((len(after), 4), np.uint64)
    for at in range(4):
        part = eight << np.uint64(2 * at) | after >> np.uint64(8 - 2 * at) if at else eight
        np.right_shift(part, np.uint64(64 - 2 * k), out=codes[:, at])
    inside = np.repeat(np.tile([True, False], len(size)), np.stack([windows, 4 * size - windows], 1).ravel())
    return codes.ravel()[inside].view(np.int64)


def side_sums(blocks: list[tuple], k: int, sides: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different codes of blocks (side, codes, n) in order, and the sum of n of each by side.

    Where most come once, code and side are sorted as one number and counted by runs, which is quicker than to sort places.
    """
    code = np.concatenate([np.frombuffer(c, np.int64) for _, c, *_ in blocks])
    cnt = np.concatenate([np.frombuffer(x, np.int32) for _, _, x, *_ in blocks]).astype(np.int64)
    which = np.repeat([s for s, *_ in blocks], [len(c) // 8 for _, c, *_ in blocks])
    if sides <= 4 and k <= 31 and cnt.sum() <= 2 * len(cnt):
        both = np.repeat(code.view(np.uint64) << np.uint64(2) | which.astype(np.uint64), cnt)
        both.sort()
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        cnt = np.diff(np.append(at, len(both)))
        code, which = (both[at] >> np.uint64(2)).view(np.int64), (both[at] & np.uint64(3)).astype(np.int64)
    else:
        order = np.argsort(code, kind="stable")
        code, cnt, which = code[order], cnt[order], which[order]
    return _by_side(code, cnt, which, sides)


def _by_side(code: np.ndarray, cnt: np.ndarray, which: np.ndarray, sides: int) -> tuple[np.ndarray, list[np.ndarray]]:
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[first], [np.add.reduceat(np.where(which == s, cnt, 0), first) if len(first) else first for s in range(sides)]


def stretch_sums(blocks: list[tuple], k: int, sides: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """side_sums of blocks (side, letters, n) of stretches, of four sides at most: some PIECE windows at a time, so that copies of one window need no more memory than its count."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held: list[np.ndarray] = []

    def add() -> None:
        both = np.concatenate(held)
        both.sort()
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        found.append((both[at], np.diff(np.append(at, len(both)))))
        held.clear()

    for side, packed, n, *_ in blocks:
        held.append(stretch_codes(packed, n, k).view(np.uint64) << np.uint64(2) | np.uint64(side))
        if sum(map(len, held)) >= PIECE:
            add()
    if held:
        add()
    both, cnt = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        order = np.argsort(both, kind="stable")
        both, cnt = both[order], cnt[order]
    return _by_side((both >> np.uint64(2)).view(np.int64), cnt, (both & np.uint64(3)).astype(np.int64), sides)


def _by_key(rows: pa.Table, keys: int) -> dict[tuple, list[tuple]]:
    """(side, codes, n, what follows) of a lot's rows by their keys."""
    columns = [c.to_pylist() for c in rows.columns]
    by: dict[tuple, list[tuple]] = {}
    for x in zip(*columns, strict=True):
        by.setdefault(x[:keys], []).append((x[keys], *x[keys + 2 :]))
    return by


def _sums_of(rows: pa.Table) -> Callable[[list[tuple], int, int], tuple[np.ndarray, list[np.ndarray]]]:
    return stretch_sums if "letters" in rows.column_names else side_sums


def _repeated(key: tuple, n: int, schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([x], f.type).take(pa.array(np.zeros(n, np.int8))) for x, f in zip(key, schema, strict=False)]


def merged(rows: pa.Table, k: int, sides: int, listed: bool, schema: pa.Schema) -> pa.Table:
    """(keys, kmer, a count a side) of a lot's (keys, side, lot, codes or letters, n). listed: only k-mers that one side more has."""
    out = []
    for key, blocks in _by_key(rows, rows.num_columns - 4).items():
        found, sums = _sums_of(rows)(blocks, k, sides + listed)
        if listed:
            in_list = sums.pop() > 0
            found, sums = found[in_list], [x[in_list] for x in sums]
        out.append(pa.Table.from_arrays([*_repeated(key, len(found), schema), spelled(found, k), *map(pa.array, sums)], schema=schema))
    return pa.concat_tables(out)


def totals(rows: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """(keys, treat, ctrl): sums over a lot's codes that treatment has (side 0), of a lot's (keys, side, lot, codes or letters, n)."""
    out = []
    for key, blocks in _by_key(rows, rows.num_columns - 4).items():
        _, (treat, ctrl) = _sums_of(rows)(blocks, k, 2)
        out.append((*key, int(treat.sum()), int(ctrl[treat > 0].sum())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def corrected(rows: pa.Table, k: int, least: int, below: int | None, schema: pa.Schema) -> pa.Table:
    """(kmer, cnt) of a lot's (keys, side, lot, codes or letters, n, scale): treatment less scaled control of each key, added up, if that is at least and below the given counts."""
    codes, sums = [], []
    for blocks in _by_key(rows, rows.num_columns - 5).values():
        found, (treat, ctrl) = _sums_of(rows)(blocks, k, 2)
        scale = blocks[0][3]
        left = np.maximum(treat - np.rint(ctrl * scale), 0).astype(np.int64) if scale is not None else treat
        some = (treat > 0) & (left > 0)
        codes.append(found[some])
        sums.append(left[some])
    code, cnt = np.concatenate(codes), np.concatenate(sums)
    if len(codes) > 1:
        order = np.argsort(code, kind="stable")
        code, cnt = code[order], cnt[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
        code, cnt = code[first], np.add.reduceat(cnt, first) if len(first) else cnt
    some = cnt >= least if below is None else (cnt >= least) & (cnt < below)
    return pa.Table.from_arrays([spelled(code[some], k), pa.array(cnt[some])], schema=schema)
