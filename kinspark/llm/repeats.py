"""Removal of passages that an earlier document has already, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.text import mix, slices, texts, utf8, words
from kinspark.session import through_table

WINDOW = 13
# Words of the phrases by which recurring windows are looked for, and of those that the automata find.
ANCHOR, PHRASE = 5, (WINDOW + 1) // 2
SHARD_BYTES = 6 * 1024 * 1024
LEAST_SHARDS = 16
SHARDS_PER_BUCKET = 4
FLUSH_ANCHORS = 1_000_000
_KEY_BYTES = 6
_DIGIT = 64
_U = np.uint64
_ODD, _SECOND = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_MASK = _U((1 << 8 * _KEY_BYTES) - 1)
_LAST_ID = np.iinfo(np.int64).max


def _packed(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    found = np.zeros((len(data) // width, 8), np.uint8)
    found[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return found.view("<u8").reshape(-1)


def _grams(hashes: np.ndarray, width: int, odd: np.uint64) -> np.ndarray:
    """A hash of every ``width`` consecutive words."""
    n = max(len(hashes) - width + 1, 0)
    run = mix(hashes[:n] ^ odd)
    for k in range(1, width):
        run = mix(run * odd + hashes[k : k + n])
    return run


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    found, size = values, 1
    while size < width:
        step = min(size, width - size)
        found = np.minimum(found[: len(found) - step], found[step:])
        size += step
    return found


def _anchors(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and the anchor of each: the least hash of its short phrases.

    Equal windows have equal anchors, so a window that recurs has an anchor that recurs; neighbours mostly share theirs.
    """
    starts = np.flatnonzero(rows[: max(len(rows) - WINDOW + 1, 0)] == rows[WINDOW - 1 :])
    return starts, (_least(_grams(hashes, ANCHOR, _ODD), WINDOW - ANCHOR + 1)[starts] if len(starts) else np.zeros(0, _U)) & _MASK


# --- which anchors recur ---------------------------------------------------------------------------------

_ASKS = "bucket int, shards binary, counts binary, keys binary"


def _asks(buckets: int):
    """Tells every bucket of anchors which shards have them.

    An anchor that two documents at hand have recurs for sure: its shards are told at once
    (a row of bucket -1 - shard), and its bucket gets one entry in the name of no shard (-1), however many documents have it.
    """

    def told(keys: np.ndarray, shards: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, keys))
        keys, shards = keys[order], shards[order]
        first = np.concatenate(([True], keys[1:] != keys[:-1]))
        alone = first & np.concatenate((first[1:], [True]))
        rows = []
        for s in np.unique(shards[~alone]):
            known = np.unique(keys[~alone & (shards == s)])
            rows.append((-1 - int(s), b"", b"", _packed(known, _KEY_BYTES)))
        keys, shards = keys[first], np.where(alone, shards, -1)[first]
        target = (keys % _U(buckets)).astype(np.int64)
        order = np.lexsort((keys, shards, target))
        keys, shards, target = keys[order], shards[order], target[order]
        cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        for a, b in zip(cuts, [*cuts[1:], len(keys)]):
            own, counts = np.unique(shards[a:b], return_counts=True)
            rows.append((int(target[a]), own.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), _packed(keys[a:b], _KEY_BYTES)))
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64]), kinds)], ["bucket", "shards", "counts", "keys"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = seen = 0
        for batch in batches:
            column, shards = texts(batch.column(1)), batch.column(0).to_numpy()
            for a, b in slices(column):
                hashes, rows = words(column.slice(a, b - a), fold=False)
                starts, anchors = _anchors(hashes, rows)
                rows = rows[starts]
                new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])))[: len(rows)]
                anchors, rows = anchors[new], rows[new]
                order = np.lexsort((rows, anchors))
                anchors, rows = anchors[order], rows[order]
                new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1])))[: len(rows)]
                anchors, rows = anchors[new], rows[new]
                kept.append((anchors, shards[a + rows], seen + rows))
                seen, size = seen + b - a, size + len(rows)
                if size >= FLUSH_ANCHORS:
                    yield from told(*(np.concatenate(c) for c in zip(*kept)))
                    kept, size = [], 0
        if size:
            yield from told(*(np.concatenate(c) for c in zip(*kept)))

    return asked


def _recurring(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a bucket that several entries have, for each shard that has them."""
    bucket, keys, shards = key[0].as_py(), [np.zeros(0, _U)], [np.zeros(0, np.int32)]
    for batch in batches:
        for own, counts, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
            if bucket < 0:
                yield _replies([-1 - bucket], [data])
            else:
                keys.append(_unpacked(data, _KEY_BYTES))
                shards.append(np.repeat(np.frombuffer(own, np.int32), np.frombuffer(counts, np.int32)))
    if bucket >= 0:
        every, owner = np.concatenate(keys), np.concatenate(shards)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        again = np.zeros(len(every), bool)
        again[1:] = every[1:] == every[:-1]
        again[:-1] |= again[1:]
        again |= np.isin(every, every[owner < 0])
        again &= owner >= 0
        every, owner = every[again], owner[again]
        order = np.argsort(owner, kind="stable")
        every, owner = every[order], owner[order]
        present, cuts = np.unique(owner, return_index=True)
        for s, part in zip(present, np.split(every, cuts[1:])):
            yield _replies([int(s)], [_packed(np.unique(part), _KEY_BYTES)])


def _replies(shards: list[int], keys: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(keys, pa.binary())], ["shard", "keys"])


# --- documents by shard ---------------------------------------------------------------------------------------

_PACKED = "shard int, ids binary, lengths binary, texts binary"


def _packed_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a batch that go to one shard, as one compressed row: texts take less than half of their size on the way."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        shards, column = batch.column(0).to_numpy(), texts(batch.column(1))
        ids = batch.column(2).fill_null(_LAST_ID).to_numpy()
        order = np.argsort(shards, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1):
            if len(own):
                data, bounds = utf8(column.take(pa.array(own)))
                values = [np.ascontiguousarray(ids[own]).astype(np.int64).tobytes(), np.diff(bounds).astype(np.int64).tobytes(), pack.compress(data.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([int(shards[own[0]])], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], ["shard", "ids", "lengths", "texts"])


def _unpacked_docs(packed: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids, ascending, and texts of a shard."""
    ids, parts = [np.zeros(0, np.int64)], [pa.array([], pa.large_string())]
    unpack = zstandard.ZstdDecompressor()
    for own, lengths, data in zip(*(packed.column(k).to_pylist() for k in ("ids", "lengths", "texts"))):
        lengths = np.frombuffer(lengths, np.int64)
        plain = unpack.decompress(data) if lengths.any() else b""
        bounds = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        ids.append(np.frombuffer(own, np.int64))
        parts.append(pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(plain)]))
    every = np.concatenate(ids)
    order = np.argsort(every, kind="stable")
    return every[order], pa.concat_arrays(parts).take(pa.array(order))


# --- which windows an earlier document has ------------------------------------------------------------------


def _shard_words(docs: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a shard by ascending id (null last), their ids, and hash and row of every word."""
    ids, column = _unpacked_docs(docs)
    found = [(h, r + a) for a, b in slices(column) for h, r in [words(column.slice(a, b - a), fold=False)]]
    hashes = np.concatenate([np.zeros(0, _U), *(h for h, _ in found)])
    rows = np.concatenate([np.zeros(0, np.int64), *(r for _, r in found)])
    return column, ids, hashes, rows


def _window_asks(buckets: int):
    """The windows of a shard whose anchors recur, once each, with the first document that has them."""

    def asked(docs: pa.Table, marks: pa.Table) -> pa.Table:
        _, ids, hashes, rows = _shard_words(docs)
        starts, anchors = _anchors(hashes, rows)
        known = np.unique(np.concatenate([np.zeros(0, _U), *(_unpacked(k, _KEY_BYTES) for k in marks.column("keys").to_pylist())]))
        starts = starts[np.isin(anchors, known)]
        first_keys = _grams(hashes, WINDOW, _ODD)[starts]
        first_keys, at = np.unique(first_keys, return_index=True)
        starts = starts[at]
        second = _grams(hashes, WINDOW, _SECOND)[starts] >> _U(32)
        target = (first_keys % _U(buckets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        cuts = np.flatnonzero(np.diff(target[order])) + 1
        parts = [p for p in np.split(order, cuts) if len(p)]
        shard = docs.column("shard")[0].as_py() if docs.num_rows else 0
        return pa.table(
            {
                "bucket": pa.array([int(target[p[0]]) for p in parts], pa.int32()),
                "shard": pa.array([shard] * len(parts), pa.int32()),
                "keys": pa.array([_packed(first_keys[p], 8) for p in parts], pa.binary()),
                "checks": pa.array([_packed(second[p], 4) for p in parts], pa.binary()),
                "ids": pa.array([ids[rows[starts[p]]].tobytes() for p in parts], pa.binary()),
            }
        )

    return asked


def _owned(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard those of its windows of this bucket that a document with a smaller id has."""
    parts = [(s, _unpacked(k, 8), _unpacked(c, 4), np.frombuffer(i, np.int64)) for batch in batches for s, k, c, i in zip(*(batch.column(n).to_pylist() for n in range(1, 5)))]
    shards = np.concatenate([np.full(len(k), s, np.int64) for s, k, _, _ in parts])
    keys, checks, ids = (np.concatenate([p[n] for p in parts]) for n in (1, 2, 3))
    order = np.lexsort((ids, checks, keys))
    new = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])))
    least = np.empty(len(ids), np.int64)
    least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = least < ids
    for s in np.unique(shards[later]):
        yield _replies([int(s)], [_packed(keys[later & (shards == s)], 8)])


# --- the automata ---------------------------------------------------------------------------------------------


def _letters(hashes: np.ndarray) -> tuple[str, int]:
    """Words as letters, a fixed number each, in 64 different ones, so that no node of an automaton has many branches."""
    known, number = np.unique(hashes, return_inverse=True)
    digits = 1
    while _DIGIT**digits < len(known):
        digits += 1
    spelt = np.empty((len(hashes), digits), np.uint8)
    for k in range(digits):
        spelt[:, k] = 48 + number // _DIGIT**k % _DIGIT
    return spelt.tobytes().decode("ascii"), digits


def _occurrences(spelt: str, digits: int, phrases: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the ``PHRASE`` words that begin at ``phrases`` occur: every document is streamed through their automaton."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    width = PHRASE * digits
    for p in phrases.tolist():
        automaton.add_word(spelt[p * digits : p * digits + width])
    if not len(automaton):
        return np.zeros(0, np.int64)
    automaton.make_automaton()
    found = [np.zeros(0, np.int64)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WINDOW:
            # A slice, as the library copies the string that it is given as a whole.
            ends = np.fromiter((end for end, _ in automaton.iter(spelt[a * digits : b * digits])), np.int64)
            found.append((ends[(ends + 1) % digits == 0] + 1) // digits - PHRASE + a)
    return np.concatenate(found)


def _phrases(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Passages are runs of recurring windows; every window holds one whole phrase of those that a passage is cut into."""
    starts = np.sort(starts)
    begin = np.concatenate(([True], (np.diff(starts) != 1) | (rows[starts[1:]] != rows[starts[:-1]])))[: len(starts)]
    first = starts[begin][np.cumsum(begin) - 1] if len(starts) else starts
    own = starts[(starts - first) % PHRASE == 0]
    ends = starts[np.append(begin[1:], True)[: len(starts)]]
    origin = starts[begin]
    tails = origin + ((ends - origin) // PHRASE + 1) * PHRASE
    return np.concatenate((own, tails[tails <= ends + WINDOW - PHRASE]))


def _removed(docs: pa.Table, replies: pa.Table) -> pa.Table:
    """One shard: confirm its recurring passages, compile them, stream its documents and cut what came earlier."""
    column, ids, hashes, rows = _shard_words(docs)
    bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
    starts = np.flatnonzero(rows[: max(len(rows) - WINDOW + 1, 0)] == rows[WINDOW - 1 :])
    gone = np.zeros(len(rows), bool)
    if len(starts):
        keys = _grams(hashes, WINDOW, _ODD)[starts]
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
        firsts, lasts = order[new], order[np.append(new[1:], True)]
        elsewhere = np.isin(keys[firsts], np.concatenate([np.zeros(0, _U), *(_unpacked(k, 8) for k in replies.column("keys").to_pylist())]))
        owner = ids[rows[starts[firsts]]]
        recurs = elsewhere | (owner < ids[rows[starts[lasts]]])
        spelt, digits = _letters(hashes)
        hits = _occurrences(spelt, digits, _phrases(starts[firsts[recurs]], rows), bounds)
        place = np.full(len(rows), -1, np.int64)
        place[starts] = np.arange(len(starts))
        around = np.unique(np.maximum(hits[:, None] - np.arange(WINDOW - PHRASE + 1), 0))
        around = place[around]
        around = around[around >= 0]
        n = number[around]
        cut = starts[around[recurs[n] & (elsewhere[n] | (owner[n] < ids[rows[starts[around]]]))]]
        steps = np.zeros(len(rows) + 1, np.int32)
        np.add.at(steps, cut, 1)
        np.add.at(steps, cut + WINDOW, -1)
        gone = np.cumsum(steps)[:-1] > 0
    kept, spans = [], []
    for k, text in enumerate(column):
        own = gone[bounds[k] : bounds[k + 1]]
        parts = text.as_py().encode("utf-8", "surrogatepass").split()
        kept.append(b" ".join(p for p, g in zip(parts, own) if not g) if own.any() else b" ".join(parts))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).reshape(-1, 2)
        spans.append([{"start": int(a), "length": int(b - a)} for a, b in edges])
    counts = np.diff(bounds)
    removed = np.array([gone[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:])], np.int64)
    return pa.table(
        {
            "id": pa.array(ids, pa.int64(), mask=ids == _LAST_ID),
            "n_words": pa.array(counts, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        }
    )


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Texts without the passages that a document with a smaller key has: ``key``, ``n_words``, ``n_removed``, ``kept``, ``spans``.

    Words are what stands between ASCII white space, unchanged. Every word goes that is covered
    by ``WINDOW`` consecutive words which also occur in a document of smaller key, judged on the
    texts as they come; the others are joined by one space (``kept``). ``spans`` are the runs of removed words.

    Documents are dealt out by hash into shards of about ``shard_bytes`` of text. Of every
    window the least hash of its five-word phrases is its anchor; buckets of anchors tell
    shards which recur. Windows with such an anchor go, once a shard, to buckets of windows, which tell those that a
    smaller key has. Each shard then compiles an automaton of its recurring passages, cut into phrases of
    seven words, of which every window holds one, and streams its documents through it;
    windows around the places found are looked up. So work grows with the text; a passage
    in a third of all documents is one entry a shard. Windows are known by 96 bits.

    A null text is empty; null keys come after all others; rows of one key are one document and do not
    cut each other. A very long text makes a large shard of its own (about 120 bytes of work a word).
    Further columns are ignored, an empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-size // shard_bytes))
    buckets = max(LEAST_SHARDS // 2, shards // SHARDS_PER_BUCKET)
    shard = F.pmod(F.xxhash64(key, text), F.lit(shards)).cast("int")
    rows = docs.select(shard.alias("shard"), F.coalesce(text, F.lit("")).alias("text"), F.col(key).cast("long").alias("id"))
    dealt = rows.select("shard", "text", "id").mapInArrow(_packed_docs, _PACKED).groupBy("shard")
    marks = rows.select("shard", "text").mapInArrow(_asks(buckets), _ASKS).groupBy("bucket").applyInArrow(_recurring, "shard int, keys binary")
    marks = through_table(marks, "anchors")
    windows = dealt.cogroup(marks.groupBy("shard")).applyInArrow(_window_asks(buckets), "bucket int, shard int, keys binary, checks binary, ids binary")
    replies = through_table(windows.groupBy("bucket").applyInArrow(_owned, "shard int, keys binary"), "windows")
    found = dealt.cogroup(replies.groupBy("shard")).applyInArrow(_removed, "id long, n_words long, n_removed long, kept string, spans array<struct<start: long, length: long>>")
    return found.withColumnRenamed("id", key)
