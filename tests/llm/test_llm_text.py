"""Word hashes, token ids, records and packing against plain versions."""

import json
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinspark.llm import packing, records, text, tokens
from kinspark.session import scratch_path

ALPHABET = st.sampled_from(list("ab AZ\t\n\x0b\x1c\x85\xa0éß́Σ'.,0<|\U0001f600") + ["<|endoftext|>", "'s", "word ", "..."])
TEXTS = st.lists(st.lists(ALPHABET, max_size=25).map("".join), max_size=8)


def plain_shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_shingles_are_those_of_the_words(rows):
    sets = text.shingle_sets(text.texts(pa.array(rows, pa.string())), 5)
    want = [plain_shingles(t) for t in rows]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for a in range(len(rows)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(want[a] & want[b])


def test_slices_cover_all_rows():
    column = text.texts(pa.array(["x" * n for n in (0, 5, 3, 100, 0, 7, 7)]))
    assert [s for s in text.slices(column, 8)] == [(0, 3), (3, 4), (4, 6), (6, 7)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(tokens.tokenizer_json(), kept=50)


@settings(deadline=None, max_examples=150)
@given(rows=TEXTS)
def test_ids_equal_the_library(encoder, rows):
    whole = Tokenizer.from_str(tokens.tokenizer_json())
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(rows)] == [whole.encode(t, add_special_tokens=False).ids for t in rows]


def test_each_distinct_word_of_a_call_is_looked_up_once():
    """However often it occurs, and whatever signs stand behind it."""

    class Asked(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    encoder = tokens.WordEncoder(tokens.tokenizer_json())
    encoder._known = Asked()
    rows = [f"word, Word! wörd. other{k % 5}\nother {'word... ' * k}" for k in range(200)]
    whole = Tokenizer.from_str(tokens.tokenizer_json())
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(rows)] == [whole.encode(t, add_special_tokens=False).ids for t in rows]
    assert encoder._known.asked <= 20


def test_ids_of_columns_equal_the_library(encoder):
    """Columns with an offset and nulls; each white space, small and capital letter, sign and control character of Latin-1."""
    whole = Tokenizer.from_str(tokens.tokenizer_json())
    for c in map(chr, (*range(256), 0x1680, 0x180E, 0x2028, 0x3000, 0x130, 0x212A, 0x331, 0x200B)):
        rows = ["left out", c, f"Ab{c}ch, {c} H{c}!{c}x {c}...", None, "", f" {c}{c}<|endoftext|>{c}", "left out"]
        found = encoder.encode(pa.array(rows, pa.large_string()).slice(1, 5))
        assert [np.frombuffer(b, "<u4").tolist() for b in found] == [whole.encode(t or "", add_special_tokens=False).ids for t in rows[1:6]]
    assert encoder.encode([]) == []


def test_words_and_signs_stay_together_where_the_tokenizer_has_them_so():
    definition = json.loads(tokens.tokenizer_json())
    definition["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]{1,2}"
    whole, rows = Tokenizer.from_str(json.dumps(definition)), ["word... a, reading!\nabc.", ""]
    found = tokens.WordEncoder(json.dumps(definition)).encode(rows)
    assert [np.frombuffer(b, "<u4").tolist() for b in found] == [whole.encode(t, add_special_tokens=False).ids for t in rows]


def test_checksum_and_frames():
    assert records.crc32c(b"123456789") == 0xE3069283
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 1023, 1024, 1025, 1027, 5000):
        data = rng.randbytes(n)
        state = 0xFFFFFFFF
        for byte in data:
            state ^= byte
            for _ in range(8):
                state = (state >> 1) ^ (records.CASTAGNOLI if state & 1 else 0)
        assert records.crc32c(data) == state ^ 0xFFFFFFFF
        record = records.framed(data)
        assert records.unframed(record) == data
        damaged = bytearray(record)
        damaged[rng.randrange(len(record))] ^= 16
        with pytest.raises(ValueError):
            records.unframed(bytes(damaged))


def expected_ids(docs, end):
    whole = Tokenizer.from_str(tokens.tokenizer_json())
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    return {k: [*whole.encode(t, add_special_tokens=False).ids, end] for k, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tasks_of_a_worker_share_an_encoder(spark, sf_dir):
    """So that words are not learnt, and the tokenizer not read, once a task."""
    definition = tokens.tokenizer_json()
    assert tokens.shared_encoder(definition) is tokens.shared_encoder(definition)

    def uses(batches):
        for _ in batches:
            info = tokens.shared_encoder.cache_info()
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "hits": [info.hits], "misses": [info.misses]})

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    records.write_records(docs, scratch_path(spark, "records"), partitions=24)
    found = spark.range(24, numPartitions=24).mapInArrow(uses, "pid long, hits long, misses long").collect()
    assert sum({r.pid: r.hits for r in found}.values()) > 0 and max(r.misses for r in found) <= 1


def test_records_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch_path(spark, "records")
    index = records.write_records(docs, path, partitions=5)
    found = records.read_records(spark, path, index, with_ids=True).collect()
    want, start = expected_ids(docs, 1), 0
    by_id = {r["doc_id"]: r for r in found}
    for k in sorted(want):
        r = by_id[k]
        assert (r["ids"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want[k], start, len(want[k]), crc(want[k]))
        start += len(want[k])
    some = records.read_records(spark, path, index.where("doc_id % 7 = 3")).collect()
    assert {r["doc_id"]: r["start"] for r in some} == {k: by_id[k]["start"] for k in want if k % 7 == 3}


def test_packing_keeps_every_id_and_pads_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3, "doc_id")
    rows = packing.pack_documents(docs, group_sequences=4, with_ids=True).collect()
    want = expected_ids(docs, 2)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == crc(r["ids"]) and len(r["ids"]) == r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: [i for _, ids in sorted(p) for i in ids] for k, p in pieces.items()} == want
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
@settings(deadline=None, max_examples=60)
def test_balance_fills_all_room(lengths):
    room = packing.capacities(sum(lengths))
    placed = packing.balance(lengths, room)
    used = Counter()
    for own in placed:
        for s, n in own:
            used[s] += n
    assert [used[k] for k in range(len(room))] == room
    assert [sum(n for _, n in own) for own in placed] == lengths


def test_balance_evens_out_attention_cost():
    rng = random.Random(5)
    lengths = [rng.choice([60, 150, 400, 1200, 2500]) for _ in range(400)]
    room = packing.capacities(sum(lengths))
    placed = packing.balance(lengths, room)
    cost = [0.0] * len(room)
    for own in placed:
        for s, n in own:
            cost[s] += packing.attention_cost(n)
    in_order, left = [0.0], packing.CAPACITY
    for n in lengths:
        while n:
            take = min(n, left)
            in_order[-1] += packing.attention_cost(take)
            n, left = n - take, left - take
            if not left:
                in_order.append(0.0)
                left = packing.CAPACITY
    full = [c for c, r in zip(cost, room) if r == packing.CAPACITY]
    assert np.std(full) < np.std(in_order[:-1])
