"""Token counts by a finite-state transducer compiled from a byte-pair vocabulary.

A first, class-driven step cuts a text into words with at most two characters of lookahead. A deterministic transducer
then reads the words' bytes, the last byte of a word being a symbol of its own. Its state is what the encoding of the
word so far can still depend on, and each transition carries the change in the number of tokens and the token that ends
there. States and transitions are compiled from the vocabulary when a text first needs them; of too many, those stay that
most blocks of texts came through.

Texts run in chunks, all chunks of a block one symbol at a time side by side. A chunk's state map takes the state that it
is entered with to the state that it is left with. It is tabulated for the states that the chunk before can be left with:
first every chunk runs from a word's start, then from each state new to it that a chunk before it in the same word ends in
(1, 2, 4, ... chunks before, round by round), until the tables are closed. Paths from different states soon meet, so tables
have one or two rows, and no more than a long word has phases. The maps then compose by a parallel prefix scan, doubling the span of the composed maps in each round, which gives
the state that each chunk is entered with.

Normal forms, lower case and the classes of characters are the library's own: its normaliser runs on every text with a
character outside a set for which Python's tables are shown to agree, its regular expressions give the classes.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import worker_state

#: Symbols in a chunk, and characters in a block of texts.
CHUNK = 128
BLOCK_CHARS = 1 << 18
#: States at which a worker forgets half of what it has compiled. Four times as many transitions have the same effect.
MAX_STATES = 160_000

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself where it is printable, and
    those from 256 on, in order, for the others."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def class_runs() -> list[tuple[int, int, int]]:
    """(class, first code point, the one after the last) by the library's regular expressions; the others are OTHER."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
    finders = [(k, pre_tokenizers.Split(Regex(p), "removed", invert=True)) for k, p in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+"))]
    out = []
    for some in np.array_split(points, 256):  # the library keeps some hundred bytes for each character that it is given
        text = some.tobytes().decode("utf-32-le")
        for kind, finder in finders:
            out += [(kind, int(some[a]), int(some[b - 1]) + 1) for _, (a, b) in finder.pre_tokenize_str(text)]
    return out


def plain_characters() -> list[tuple[int, int]]:
    """Ranges of code points of which a text is in normal form as it stands, and whose lower case Python has like the
    library: no marks, no jamo, nothing that Python's tables lack or that either of them changes by itself."""

    def plain(c: int) -> bool:
        x = chr(c)
        kind = unicodedata.category(x)
        if kind[0] == "M" or kind in ("Cn", "Co", "Cs") or unicodedata.combining(x) or 0x1100 <= c < 0x1200 or 0xA960 <= c < 0xA980 or 0xD7B0 <= c < 0xD800:
            return False
        return unicodedata.normalize("NFC", x) == x == nfc.normalize_str(x) and low.normalize_str(x) == x.lower()

    nfc, low = normalizers.NFC(), normalizers.Lowercase()
    flags = np.array([False, *(plain(c) for c in range(0x10000)), False])
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def load_model(path: str) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int]]]:
    """What a worker needs to build a transducer: the vocabulary file's text, the classes and the plain characters."""
    with open(path, encoding="utf-8") as f:
        return f.read(), class_runs(), plain_characters()


#: How the vocabulary normalises and splits. Others are refused.
NORMALISERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def numbers_of(n: int) -> Struct:
    """How a state's numbers are written, for a context of n bytes: 6 * n + 7 bytes."""
    return Struct(f"<?{n + 1}i{n + 1}h")


def packed(context: bytes, at_start: bool, lasts: list[int], counts: list[int]) -> bytes:
    """A state as one small object, as a worker keeps up to MAX_STATES. lasts and counts have one number more than context
    has bytes."""
    return numbers_of(len(context)).pack(at_start, *lasts, *counts) + context


def unpacked(state: bytes) -> tuple[bytes, bool, list[int], list[int]]:
    n = len(state) // 7 - 1
    at_start, *numbers = numbers_of(n).unpack_from(state)
    return state[6 * n + 7 :], at_start, numbers[: n + 1], numbers[n + 1 :]


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n rows and more. New rows are zeros that take no memory until they are written."""
    out = np.zeros((n + len(a) // 8 + 1024, *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class Transducer:
    """Lazily compiled; one per worker process and vocabulary."""

    def __init__(self, model_json: str, classes: list[tuple[int, int, int]], plain: list[tuple[int, int]]):
        spec = json.loads(model_json)
        model, form = spec["model"], spec.get("normalizer") or {}
        if model["type"] != "BPE" or not model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE vocabulary with word ends is needed")
        if [n["type"] for n in form.get("normalizers", [])] != NORMALISERS or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": WORD_PATTERN}:
            raise ValueError("a vocabulary that normalises and splits otherwise")
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, a, b in classes:
            self.kinds[a:b] = kind
        self.odd = re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in plain) + "]")
        self.normaliser = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        chars = byte_characters()
        symbol = {s: [vocab[c + end] for c in chars] for s, end in ((0, ""), (1, suffix))}
        self.of_symbol = symbol[0] + symbol[1]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank of the merge that makes it, and its parts
        text_of = {i: (bytes([b]), end) for end in (0, 1) for b, i in enumerate(symbol[end])}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair, new = (vocab[a], vocab[b]), vocab[a + b]
            self.merges.setdefault(pair, (rank, new))
            self.made.setdefault(new, (rank, *pair))
            text_of[new] = (text_of[pair[0]][0] + text_of[pair[1]][0], text_of[pair[1]][1])
        self.text_of = text_of
        self.id_of = [{t: k for k, (t, e) in text_of.items() if e == end} for end in (0, 1)]
        self.prefixes = {t[:k] for t, end in text_of.values() for k in range(1, len(t) + end)}
        self.longest = max(len(t) for t, _ in text_of.values())
        self.token_bytes = np.zeros(max(text_of) + 1, np.int32)
        for i, (t, _) in text_of.items():
            self.token_bytes[i] = len(t)
        self._fits: dict[int, bool] = {}
        # a state's transitions by symbol, in parts of 16 symbols: which part, and the parts (0: no transition yet); part 0 is empty
        self.part = np.zeros((MAX_STATES, 32), np.int32)
        self.parts, self.n_parts = np.zeros((2 * MAX_STATES, 16), np.int32), 1
        # of each transition: state << 9 | symbol, the state after it, the token that ends, the change of their number
        self.origin, self.next, self.token, self.change = (np.zeros(3 * MAX_STATES, t) for t in (np.int32, np.int32, np.int32, np.int8))
        self.n_transitions = 1
        self.states = [packed(b"", True, [-1], [0])]  # state 0 is the start of a word
        self.number = {self.states[0]: 0}
        self.uses = np.zeros(MAX_STATES, np.int32)  # blocks that came through each state; older ones count less

    def forget(self) -> None:
        """Keep half of MAX_STATES, those that most blocks came through, and the transitions between them, of which the ones
        from the most used states if they are more than twice MAX_STATES."""
        n, m = len(self.states), self.n_transitions
        keep = np.zeros(n, bool)
        keep[np.argsort(-self.uses[:n], kind="stable")[: MAX_STATES // 2]] = True
        keep[0] = True
        new = np.cumsum(keep, dtype=np.int32) - 1
        kept = 1 + np.flatnonzero(keep[self.origin[1:m] >> 9] & keep[self.next[1:m]])
        if len(kept) > 2 * MAX_STATES:
            kept = np.sort(kept[np.argsort(-self.uses[self.origin[kept] >> 9], kind="stable")[: 2 * MAX_STATES]])
        self.n_transitions = 1 + len(kept)
        held = slice(1, self.n_transitions)
        for a in (self.origin, self.next, self.token, self.change):
            a[held] = a[kept]
        self.next[held] = new[self.next[held]]
        origin = self.origin[held] = new[self.origin[held] >> 9] << 9 | self.origin[held] & 511
        self.part[:n] = 0
        self.parts[: self.n_parts] = 0
        found, place = np.unique(origin >> 4, return_inverse=True)
        self.n_parts = 1 + len(found)
        self.part.reshape(-1)[found] = np.arange(1, self.n_parts)
        self.parts[1 + place, origin & 15] = np.arange(1, self.n_transitions)
        self.states = [s for s, k in zip(self.states, keep.tolist(), strict=True) if k]
        self.number = {s: i for i, s in enumerate(self.states)}
        uses = self.uses[:n][keep] // 2
        self.uses[:] = 0
        self.uses[: len(uses)] = uses

    def merge(self, ids: list[int]) -> list[int]:
        """Byte-pair encoding by rank."""
        ids = list(ids)
        while len(ids) > 1:
            best = min(((m[0], i) for i in range(len(ids) - 1) if (m := self.merges.get((ids[i], ids[i + 1])))), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def symbols(self, token: int) -> list[int]:
        text, end = self.text_of[token]
        out = [self.of_symbol[b] for b in text]
        if end:
            out[-1] = self.of_symbol[256 + text[-1]]
        return out

    def fits(self, before: int, token: int) -> bool:
        """True if the encoding keeps both tokens side by side; before is -1 at a word's start."""
        if (found := self._fits.get(before << 20 | token)) is None:
            if len(self._fits) > MAX_STATES:
                self._fits.clear()
            if before < 0:
                found = self.merge(self.symbols(token)) == [token]
            else:
                found = self.fits(-1, before) and self.fits(-1, token) and self.apart(before, token)
            self._fits[before << 20 | token] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """True if no merge joins the two tokens at any time: their merges are undone, the latest first (of equals the
        right one's), and those across the bound looked up that would have come before the one undone last."""
        none = (-1, -1, -1)
        limit = len(self.merges)
        while True:
            if (across := self.merges.get((left, right))) and across[0] < limit:
                return False
            a, b = self.made.get(left, none), self.made.get(right, none)
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:
                limit, left = a[0], a[2]
            else:  # an equal merge across the bound would be further left, so before it
                limit, right = b[0] + 1, b[1]

    def compile(self, state: int, symbol: int) -> None:
        """Add the transition: the encoding of the longer word is that of one of its prefixes and one more token."""
        context, at_start, lasts, counts = unpacked(self.states[state])
        byte, end = bytes([symbol & 255]), symbol >> 8
        text = context + byte
        ends, ids = [text[k:] for k in range(len(text))], self.id_of[end]
        for k in range(max(0, len(text) - self.longest), len(text)):
            if (token := ids.get(ends[k])) is not None and self.fits(lasts[k], token):
                break
        else:
            raise AssertionError("every byte is a token")
        count = counts[k] + 1
        if end:
            target = 0
        else:
            # only where a later token can start does it matter which token and count come before
            live = [e in self.prefixes for e in ends] + [True]
            cut = live.index(True)
            live, lasts, counts = live[cut:], [*lasts, token][cut:], [*counts, count][cut:]
            key = packed(text[cut:], at_start and not cut, [t if x else -2 for t, x in zip(lasts, live)], [c - count if x else 0 for c, x in zip(counts, live)])
            if (target := self.number.get(key)) is None:
                target = self.number[key] = len(self.states)
                self.states.append(key)
                if target >= len(self.part):
                    self.part, self.uses = grown(self.part, target + 1), grown(self.uses, target + 1)
        i = self.n_transitions
        if i >= len(self.next):
            self.origin, self.next, self.token, self.change = (grown(a, i + 1) for a in (self.origin, self.next, self.token, self.change))
        self.origin[i], self.next[i], self.token[i], self.change[i] = state << 9 | symbol, target, token, count
        self.n_transitions += 1
        if not (part := self.part[state, symbol >> 4]):
            part = self.part[state, symbol >> 4] = self.n_parts
            self.n_parts += 1
            if part >= len(self.parts):
                self.parts = grown(self.parts, self.n_parts)
        self.parts[part, symbol & 15] = i

    def find(self, state: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Transitions from states by symbols 16 * high + low, 0 where there is none yet."""
        return self.parts.reshape(-1).take(self.part.reshape(-1).take(state * 32 + high) * 16 + low)

    def step(self, state: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Transitions from states by symbols."""
        found = self.find(state, high, low)
        if found.size and not found.min():
            missing = np.flatnonzero(found == 0)
            for s, h, x in {*zip(state[missing].tolist(), high[missing].tolist(), low[missing].tolist(), strict=True)}:
                self.compile(s, 16 * h + x)
            found = self.find(state, high, low)
        return found

    def run(self, symbols: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """(token that ends at each symbol, change of the number of tokens there) for a stream of whole words."""
        if len(self.states) > MAX_STATES or self.n_transitions > 4 * MAX_STATES:
            self.forget()
        m = len(symbols)
        lanes = -(-m // chunk)
        flat = np.full(lanes * chunk, 256 + 33, np.int16)  # one-byte words fill the last chunk
        flat[:m] = symbols
        flat = np.ascontiguousarray(flat.reshape(lanes, chunk).T).astype(np.int32)
        high, low = flat >> 4, flat & 15
        taken = np.empty((chunk, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(chunk):
            taken[t] = self.step(state, high[t], low[t])
            state = self.next.take(taken[t])
        # rows of the tables: chunk << 32 | state entered with, state left with, transitions taken
        keys, left, paths = [np.arange(lanes, dtype=np.int64) << 32], [state], [taken]
        known = keys[0]
        ended = np.where((flat >= 256).any(0), np.arange(lanes), lanes - 1)
        ended = np.append(np.minimum.accumulate(ended[::-1])[::-1], -1)  # the first chunk from each on with a word's end
        reach = 1  # chunks that a new state is asked of: after a round, twice as many of the same word
        while True:
            after = (keys[-1] >> 32) + 1
            asked = np.concatenate([(after + k << 32 | left[-1])[after + k <= ended[after]] for k in range(reach)])
            asked = np.setdiff1d(np.unique(asked), known, assume_unique=True)
            reach *= 2
            if not len(asked):
                break
            lane, state = asked >> 32, (asked & 0xFFFFFFFF).astype(np.int32)
            path, end, open_ = taken[:, lane], left[0][lane], np.arange(len(asked))
            for t in range(chunk):  # until the path is that of the run from a word's start
                at = lane[open_]
                new = self.step(state, high[t, at], low[t, at])
                path[t, open_] = new
                state = self.next[new]
                apart = state != self.next[taken[t, at]]
                open_, state = open_[apart], state[apart]
                if not len(open_):
                    break
            end[open_] = state
            keys.append(asked)
            left.append(end)
            paths.append(path)
            known = np.union1d(known, asked)
        key, end, path = np.concatenate(keys), np.concatenate(left), np.concatenate(paths, axis=1)
        entered = compose(key, end, lanes)
        taken = path[:, entered].T.reshape(-1)[:m]
        through = np.zeros(len(self.states), bool)
        through[self.next[taken]] = True
        self.uses[: len(through)] += through
        return self.token[taken], self.change[taken]


def compose(key: np.ndarray, left: np.ndarray, lanes: int) -> np.ndarray:
    """The row of each chunk that a run from the first row of chunk 0 takes. Rows are the chunks' maps (chunk << 32 |
    entered, left), closed under each other; spans of maps are composed to twice their length in each round."""
    if not lanes:
        return np.zeros(0, np.int64)
    order = np.argsort(key)
    after = ((key >> 32) + 1 << 32) | left
    step = np.append(order[np.minimum(np.searchsorted(key, after, sorter=order), len(key) - 1)], len(key))
    step[:-1][key >> 32 == lanes - 1] = len(key)  # the end of the text, which stays where it is
    at = np.zeros(lanes, np.int64)
    done = 1
    while done < lanes:
        n = min(done, lanes - done)
        at[done : done + n] = step[at[:n]]
        step = step[step]
        done *= 2
    return at


def transducer(model: tuple) -> Transducer:
    return worker_state(("transducer", hash(model[0])), lambda: Transducer(*model))


def normalise(machine: Transducer, text: str) -> str:
    """Normal form C, white space, lower case, as the library has them. (White space of a plain text stays, as it is no
    part of a word either way.)"""
    if text.isascii():
        return text.lower()
    if machine.odd.search(text):
        return machine.normaliser.normalize_str(text)
    return text.replace("Σ", "σ").lower()


def word_symbols(machine: Transducer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all words of all texts; end of each text in them) for normalised texts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = machine.kinds[points]
    same = np.zeros(len(kind), bool)
    same[1:] = (kind[1:] == kind[:-1]) & (kind[1:] != DIGIT)
    start = ~same & (kind != SPACE)
    quotes = np.flatnonzero((points == 39) & start)
    if len(quotes):
        padded = np.concatenate([points, [0, 0]])
        a, b = padded[quotes + 1], padded[quotes + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        start[quotes[one | two] + 1] = False
        for n, at in ((2, quotes[one]), (3, quotes[two])):
            start[(at + n)[kind[at + n] == LETTER]] = True
    space = kind == SPACE
    ends = np.cumsum([len(t) + 1 for t in texts])
    if not joined.isascii():
        sizes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        first = np.cumsum(sizes) - sizes
        spread = np.zeros(int(sizes.sum()), bool)
        spread[first[start]] = True
        start, space = spread, np.repeat(space, sizes)
        ends = np.concatenate([first, [len(space)]])[ends]
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    final = np.ones(len(data), bool)
    final[:-1] = start[1:] | space[1:]
    inside = ~space
    symbols = (data.astype(np.int16) + (final.astype(np.int16) << 8))[inside]
    return symbols, np.concatenate([[0], np.cumsum(inside)])[ends]


def pieces(text: str, specials: re.Pattern) -> Iterator[str]:
    """The parts between special strings (alternating with them), the former cut at white space into blocks."""
    parts = specials.split(text) if "<" in text else [text]
    for k, part in enumerate(parts):
        if k % 2:
            yield part
            continue
        at = 0
        while len(part) - at > BLOCK_CHARS:
            cut = next((i for i in range(at + BLOCK_CHARS, at, -1) if part[i] in " \n\t"), 0) or next((i for i in range(at + BLOCK_CHARS, len(part)) if part[i] in " \n\t"), len(part))
            yield part[at:cut]
            yield ""
            at = cut
        yield part[at:]


def blocks(machine: Transducer, texts: list[str]) -> Iterator[tuple[list[str], list[int], list[str]]]:
    """(parts, the text of each part, the special string after each part) of about BLOCK_CHARS characters together."""
    parts: list[str] = []
    owners: list[int] = []
    after: list[str] = []
    size = 0
    specials = special_pattern(machine)
    for i, text in enumerate(texts):
        row = list(pieces(text, specials))
        for k in range(0, len(row), 2):
            parts.append(normalise(machine, row[k]))
            owners.append(i)
            after.append(row[k + 1] if k + 1 < len(row) else "")
            size += len(parts[-1]) + 1
            if size >= BLOCK_CHARS:
                yield parts, owners, after
                parts, owners, after, size = [], [], [], 0
    if parts:
        yield parts, owners, after


def special_pattern(machine: Transducer) -> re.Pattern:
    return re.compile("(" + "|".join(re.escape(s) for s in sorted(machine.specials, key=len, reverse=True)) + ")") if machine.specials else re.compile(r"((?!))")


def slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a few rows at a time, about BLOCK_CHARS bytes or one long text; null is empty."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_CHARS, "right")))
        yield at, [t or "" for t in column.slice(at, to - at).to_pylist()]
        at = to


def count(machine: Transducer, texts: list[str]) -> np.ndarray:
    """Number of tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    for parts, owners, after in blocks(machine, texts):
        symbols, ends = word_symbols(machine, parts)
        totals = np.concatenate([[0], np.cumsum(machine.run(symbols)[1], dtype=np.int64)])[ends]
        np.add.at(out, owners, np.diff(totals, prepend=0) + np.array([bool(a) for a in after]))
    return out


def encode(machine: Transducer, texts: list[str]) -> list[np.ndarray]:
    """The ids of each text's tokens."""
    rows: list[list[np.ndarray]] = [[] for _ in texts]
    for parts, owners, after in blocks(machine, texts):
        symbols, ends = word_symbols(machine, parts)
        token, _ = machine.run(symbols)
        used = np.zeros(len(symbols), bool)
        at = np.flatnonzero(symbols >= 256)  # from each word's end back to its start
        begin = np.zeros(len(symbols), np.int64)
        begin[at] = np.concatenate([[0], at[:-1] + 1])
        begin = begin[at]
        while len(at):
            used[at] = True
            at = at - machine.token_bytes[token[at]]
            more = at >= begin
            at, begin = at[more], begin[more]
        ids = token[used].astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(used)])[ends]
        start = 0
        for i, cut, special in zip(owners, cuts.tolist(), after, strict=True):
            rows[i].append(ids[start:cut])
            if special:
                rows[i].append(np.array([machine.specials[special]], np.uint32))
            start = cut
    return [np.concatenate(r) if r else np.zeros(0, np.uint32) for r in rows]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, n_bytes, n_tokens (long), over_limit (n_tokens > limit).

    The vocabulary is read on the driver and broadcast (a file of a few MB, and some thousand ranges of characters). A null text counts as empty, with no
    tokens. Special strings inside a text are one token each. A text of any length is read in blocks. Equal rows give
    equal rows; other columns aren't read. No rows in: no rows out.
    """
    model = docs.sparkSession.sparkContext.broadcast(load_model(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model.value)
        for batch in batches:
            n = np.concatenate([count(machine, texts) for _, texts in slices(batch.column(1))] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], schema=out)

    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`"), text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).mapInArrow(run, schema)
