from __future__ import annotations

import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stormloom.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def machine():
    return tokens.transducer(tokens.load_model(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts() -> list[str]:
    rng = random.Random(1)
    letters = "aabcdefgst'' .\n0123<|>endoftextÀéßñσΣİ漢字😀\u0301\u00a0re've'll_-"
    fixed = ["", " ", "don't 'tis ''s 'rx 're-do we'll", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "e\u0301", "a" * 3000, "ab" * 2000, "x1y22z", "'", "''", "'s's", "o'reilly'd"]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(800)]


def test_ids_are_the_library_s(machine, library):
    rows = texts()
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.encode(machine, rows)] == want
    assert tokens.count(machine, rows).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_chunks_compose(machine, chunk):
    symbols, _ = tokens.word_symbols(machine, [tokens.normalise(machine, t) for t in texts()])
    token, change = machine.run(symbols)
    other = machine.run(symbols, chunk)
    assert (token == other[0]).all() and (change == other[1]).all()


def test_maps_compose_in_few_rounds(machine, library):
    """Long words without an end inside a chunk: their maps are no constants, and no round per chunk is needed."""
    rng = random.Random(9)
    rows = ["a" * 30_000, "ab" * 15_000, "haha" * 5000 + "x" * 5000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "-" * 20_001]
    steps, plain = [], machine.step

    def counted(state, high, low):
        steps.append(len(state))
        return plain(state, high, low)

    machine.step = counted
    try:
        got = [x.tolist() for x in tokens.encode(machine, rows)]
    finally:
        del machine.step
    assert got == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert len(steps) < 12 * tokens.CHUNK  # 234 chunks each


def test_tokens_that_stay_apart(machine):
    """Undoing merges says the same as merging."""
    rng = random.Random(8)
    tokens_ = [t for t in machine.text_of if machine.fits(-1, t)]
    inner, common = [t for t in tokens_ if not machine.text_of[t][1]], list(range(512, 3000))
    pairs = [(rng.choice(inner), rng.choice(tokens_)) for _ in range(4000)] + [(a, b) for a, b in ((rng.choice(common), rng.choice(common)) for _ in range(8000)) if a in machine.text_of and b in machine.text_of and not machine.text_of[a][1]]
    pairs += [(t, t) for t in inner[:3000]] + [(machine.made[t][1], machine.made[t][2]) for t in tokens_[2000:4000] if t in machine.made]
    said = [machine.fits(a, b) for a, b in pairs]
    assert said == [machine.merge(machine.symbols(a) + machine.symbols(b)) == [a, b] and machine.fits(-1, a) and machine.fits(-1, b) for a, b in pairs]
    assert 0.1 < sum(said) / len(said) < 0.99


def test_composition_of_maps():
    rng = np.random.default_rng(3)
    for lanes in (1, 2, 5, 64, 100):
        maps = rng.integers(0, 6, (lanes, 6))
        key = (np.repeat(np.arange(lanes), 6) << 32) | np.tile(np.arange(6), lanes)
        state, want = 0, []
        for k in range(lanes):
            want.append(6 * k + state)
            state = maps[k, state]
        assert tokens.compose(key, maps.reshape(-1), lanes).tolist() == want


@pytest.mark.parametrize("context", ["a{c}b", ".{c}.", "x{c}'s", "e{c}\u0301", "{c}{c}{c}", "1{c}1"])
def test_every_kind_of_character(machine, library, context):
    """All code points but most of the large blocks of ideographs, syllables and private or unassigned characters."""
    dull = [(0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xE000, 0xF8FF), (0x17000, 0x18CFF), (0x20000, 0x2EE5F), (0x30000, 0x323AF), (0x323B0, 0xDFFFF), (0xE0200, 0x10FFFF)]
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 1009 == 0 or not any(a + 2 < c < b - 2 for a, b in dull))]
    words = [context.replace("{c}", chr(c)) for c in points]
    rows = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    got = [x.tolist() for x in tokens.encode(machine, rows)]
    assert [hex(points[50 * k]) for k in range(len(rows)) if got[k] != want[k]] == []


def test_random_characters(machine, library):
    rng = random.Random(4)
    rows = ["".join(chr(c) for c in (rng.randrange(1, 0x32400) for _ in range(30)) if not 0xD800 <= c < 0xE000) for _ in range(1000)]
    assert [x.tolist() for x in tokens.encode(machine, rows)] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def test_forgetting_changes_nothing(machine, library, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 10)
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    rows = texts()[:200]
    assert tokens.count(machine, rows).tolist() == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]


def test_used_states_stay(library, monkeypatch):
    """Of too many states, those go that few blocks came through."""
    monkeypatch.setattr(tokens, "MAX_STATES", 3000)
    rng = random.Random(5)
    machine = tokens.Transducer(*tokens.load_model(PATH))
    common = ["the rain in spain stays mainly in the plain, they said; 12 times"]
    compiled, plain = [], machine.compile

    def counted(state, symbol):
        compiled.append(state)
        plain(state, symbol)

    machine.compile = counted
    for _ in range(40):
        junk = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(600))]
        assert [x.tolist() for x in [*tokens.encode(machine, common), *tokens.encode(machine, junk)]] == [e.ids for e in library.encode_batch(common + junk, add_special_tokens=False)]
        assert len(machine.states) < 4000
    assert len(compiled) > 3 * 3000
    compiled.clear()
    tokens.encode(machine, common)
    assert compiled == []


def test_few_states_with_many_transitions(library, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 100)
    rng = random.Random(7)
    machine = tokens.Transducer(*tokens.load_model(PATH))
    for _ in range(60):
        rows = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(50))]
        assert tokens.encode(machine, rows)[0].tolist() == library.encode(rows[0], add_special_tokens=False).ids
        assert len(machine.states) < 100 and machine.n_transitions < 4 * 100 + 100


HELD = """
import random, re
import public_tokenizers
from stormloom.llm import tokens
from stormloom.llm.common import release_memory

def held():
    release_memory()
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

rng = random.Random(6)
machine = tokens.Transducer(*tokens.load_model(public_tokenizers.path("word_bpe_49k.json")))
before, most = held(), 0
for _ in range(60):
    tokens.encode(machine, ["".join(rng.choice("aabcdeeefghiilmnoooprsttu    ") for _ in range(10_000))])
    most = max(most, len(machine.states))
print(most, held() - before)
"""


def test_a_worker_s_memory():
    """What a worker holds when it has seen as many states as it keeps: beside its executor's heap there is little room."""
    ran = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, timeout=300)
    most, mb = ran.stdout.split()
    assert int(most) > 150_000
    assert float(mb) < 95  # 62, and 130 with states as tuples


def test_count_tokens(docs, no_docs, library):
    got = tokens.count_tokens(docs, PATH, 100).collect()
    rows = docs.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 100) for r in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert tokens.count_tokens(no_docs, PATH, 100).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.transducer(tokens.load_model(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_optimal(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
    room = rng.randrange(1, 90)
    found = packing.fullest(counts, sorted(counts, reverse=True), room)
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    assert sum(n * k for n, k in found) == max(s for s in sums if s <= room)
    assert all(k <= counts[n] for n, k in found)


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts: dict[int, int] = {}
    for _ in range(4000):
        n = min(256, int(rng.lognormvariate(4, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan_bins(dict(counts), 256)
    used: dict[int, int] = defaultdict(int)
    for times, items in plan:
        assert sum(n * k for n, k in items) <= 256
        for n, k in items:
            used[n] += times * k
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.005 * sum(n * c for n, c in counts.items()) / 256 + 1


def test_plan_is_that_of_one_bin_at_a_time():
    """The same number of bins as filling bin after bin by the fullest subset of single pieces."""
    rng = random.Random(5)
    for _ in range(5):
        pieces = sorted((rng.randrange(1, 30) for _ in range(60)), reverse=True)
        counts = {n: pieces.count(n) for n in set(pieces)}
        bins, left = 0, list(pieces)
        while left:
            room = 40 - left.pop(0)
            best: dict[int, list[int]] = {0: []}
            for k, n in enumerate(left):
                for total, used in list(best.items()):
                    if total + n <= room and total + n not in best:
                        best[total + n] = [*used, k]
            for k in reversed(best[max(best)]):
                left.pop(k)
            bins += 1
        assert abs(sum(t for t, _ in packing.plan_bins(counts, 40)) - bins) <= 1


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pack_documents(docs, no_docs, library, capacity):
    rows = packing.pack_documents(docs, PATH, capacity).collect()
    want = []
    for d in docs.collect():
        ids = np.array([*library.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(d.doc_id), k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(ids[k : k + capacity].tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / capacity + 1
    assert packing.pack_documents(no_docs, PATH, capacity).count() == 0


def test_a_piece_that_is_too_long(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 9)], "id long, length long"), 8)
