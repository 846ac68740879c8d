"""Token counts by a tokenizer compiled to a deterministic transducer.

The transducer reads a normalised text character by character. A state holds what of the
current pre-token can still matter: its longest end with which a token may begin, and, at
each place of it, the last token and the number of tokens of the encoding up to there. A
transition is annotated with the tokens that it emits: by how many the encoding of what was
read has grown (a character that lets tokens grow together emits a negative number); white
space and other edges of pre-tokens emit what the word end changes. The next state follows
from the merge table: the encoding of a prefix ends in the one token that fits onto the
encoding before it, and whether two tokens fit is decided by their merge histories.
Transitions are compiled when first taken. Beyond STATES states all are forgotten and
compiled anew as needed, so memory is bounded; the result doesn't change.

A chunk of text is a map from the state before it to the state after it and the tokens
emitted. White space leads to the start from any state, so a chunk that has some sends all
states to one; what stands before its first white space is applied to the state that comes
in. Such maps compose associatively: every text is cut into chunks of CHUNK characters,
whose maps are combined by a prefix scan in a balanced tree. Whole words from the start to
the start are remembered (up to WORDS) as an aid.

Null text counts as empty: 0 bytes, 0 tokens. Rows are independent, repeated ones alike;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import map_batches

STATES, WORDS, CHUNK = 200_000, 150_000, 1 << 13
#: White space as the tokenizer has it: less than str.split() knows.
SPACE = "[\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]"
SPACES = re.compile(SPACE + "+")
ODD_SPACES = re.compile("[\x1c-\x1f]")
# What follows an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
NEVER = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge table, and which tokens fit beside each other."""

    def __init__(self, merges: list, vocabulary: dict, suffix: str):
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {a + b: (a, b, i) for i, (a, b) in enumerate(pairs)}
        self.suffix = suffix
        self.tokens = {t for t in vocabulary if t in self.parts or len(t.removesuffix(suffix)) == 1}
        # with what a token may begin; a token for word ends goes on after its last character
        bare = [(t, len(t) - 1) if not suffix or not t.endswith(suffix) else (t, len(t) - len(suffix)) for t in self.tokens]
        self.starts = {t[:i] for t, n in bare for i in range(n + 1)}
        self.spines: dict[tuple[str, int], list] = {}

    def spine(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces that a token has had at its left (0) or right (1) end, each with the merge that used it up, latest first."""
        key = (token, side)
        if key not in self.spines:
            out, until, piece = [], NEVER, token
            while True:
                out.append((piece, until))
                if piece not in self.parts:
                    break
                until, piece = self.parts[piece][2], self.parts[piece][side]
            self.spines[key] = out
        return self.spines[key]

    def fit(self, a: str, b: str) -> bool:
        """Whether a text that is encoded as a, then one encoded as b, is encoded as a, b together.

        It isn't if pieces that met at the edge while both were whole would have been merged
        first: before the right one was used up, or at once with it (the leftmost pair goes first).
        """
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < until_x and rank <= until_y and rank < NEVER:
                return False
            made_x = self.parts[x][2] if x in self.parts else -1
            made_y = self.parts[y][2] if y in self.parts else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                i += 1
            else:
                j += 1


class State(dict):
    """Transitions by character, to (state, tokens emitted); those not taken before are compiled."""

    __slots__ = ("machine", "kind", "ends", "last")

    def __init__(self, machine: Transducer, kind: str, ends: tuple, last: int):
        super().__init__()
        self.machine, self.kind, self.ends, self.last = machine, kind, ends, last

    def __missing__(self, c: str):
        self[c] = found = self.machine.step(self, c)
        return found


#: What a word has before its first character: nothing to go on with, no token, no count.
EMPTY = ("", ("",), (0,))


class StateMap:
    """What a chunk does to the state before it: its head is applied to that; reset is (state, tokens) after the head's white space."""

    __slots__ = ("head", "reset")

    def __init__(self, head: tuple[str, ...], reset: tuple[State, int] | None):
        self.head, self.reset = head, reset

    def at(self, state: State) -> tuple[State, int]:
        total = 0
        for part in self.head:
            for c in part:
                state, n = state[c]
                total += n
        if self.reset is None:
            return state, total
        return self.reset[0], total + state.last + self.reset[1]

    def then(self, other: StateMap) -> StateMap:
        if self.reset is None:
            return StateMap(self.head + other.head, other.reset)
        state, total = other.at(self.reset[0])
        return StateMap(self.head, (state, self.reset[1] + total))


class Transducer:
    """A word-ending BPE tokenizer (lower case, white space dropped)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.merges = Merges(spec["model"]["merges"], spec["model"]["vocab"], self.suffix)
        self.symbols = byte_symbols()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.marks = tuple({s[:2] for s in special})
        self.letter, self.digit = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
        self.words: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("", EMPTY)

    # ---- compilation ----

    def grown(self, ends: tuple, c: str) -> tuple[tuple, int]:
        """What a pre-token's ends become with a character more, and by how many tokens its encoding grows."""
        total = 0
        for b in c.encode("utf-8"):
            text, lasts, counts = ends
            text += self.symbols[b]
            for at in range(len(text)):  # the longest token first
                token = text[at:]
                if token in self.merges.tokens and (not lasts[at] or self.merges.fit(lasts[at], token)):
                    break
            grows = counts[at] + 1
            keep = next(i for i in range(len(text) + 1) if text[i:] in self.merges.starts)
            ends = (text[keep:], (*lasts, token)[keep:], (*(n - grows for n in counts), 0)[keep:])
            total += grows
        return ends, total

    def closing(self, ends: tuple) -> int:
        """By how many tokens the encoding grows when the pre-token ends here."""
        text, lasts, counts = ends
        for at in range(len(text)):
            token = text[at:] + self.suffix
            if token in self.merges.tokens and (not lasts[at] or self.merges.fit(lasts[at], token)):
                return counts[at] + 1
        return 0

    def state(self, kind: str, ends: tuple) -> State:
        """kind: letters, other signs, an apostrophe at a pre-token's start (') or that and a letter ('r), or none (empty)."""
        key = (kind, ends)
        if key not in self.states:
            self.states[key] = State(self, kind, ends, self.closing(ends) if kind else 0)
        return self.states[key]

    def step(self, state: State, c: str) -> tuple[State, int]:
        if SPACES.match(c):
            return self.start, state.last
        if state.kind.startswith("'") and (said := state.kind[1:] + c) in CONTRACTIONS:
            before = self.whole("'") + self.grown(EMPTY, state.kind[1:])[1] if said != c else self.grown(EMPTY, "'")[1]
            return self.start, self.whole("'" + said) - before
        if self.digit(c):
            return self.start, state.last + self.whole(c)
        if self.letter(c):
            kind = "letters"
            if state.kind == "'" and any(x.startswith(c) for x in CONTRACTIONS):
                kind = "'" + c
            goes_on = state.kind == "letters" or len(state.kind) == 2
        else:
            goes_on = state.kind in ("signs", "'")
            kind = "'" if c == "'" and not goes_on else "signs"
        ends, grows = self.grown(state.ends if goes_on else EMPTY, c)
        return self.state(kind, ends), grows + (0 if goes_on else state.last)

    def whole(self, pretoken: str) -> int:
        ends, grows = self.grown(EMPTY, pretoken)
        return grows + self.closing(ends)

    # ---- counting ----

    def word(self, text: str) -> int:
        """Tokens of a word (no white space), from the start to the start."""
        n = self.words.get(text)
        if n is None:
            state, n = self.walk(text)
            n += state.last
            if len(self.words) < WORDS and len(text) <= 64:
                self.words[text] = n
        return n

    def walk(self, text: str) -> tuple[State, int]:
        state, total = self.start, 0
        for c in text:
            state, n = state[c]
            total += n
        return state, total

    def chunk(self, text: str) -> StateMap:
        """The state map of a chunk."""
        first = SPACES.search(text)
        if first is None:
            return StateMap((text,) if text else (), None)
        rest = text[first.end() :]
        words = [w for w in SPACES.split(rest) if w] if ODD_SPACES.search(rest) else rest.split()
        tail = words.pop() if words and not SPACES.match(rest[-1]) else ""
        state, total = self.walk(tail)
        return StateMap((text[: first.start()],), (state, total + sum(map(self.word, words))))

    def scan(self, maps: list[StateMap]) -> StateMap:
        """The maps composed in order, pairs of neighbours at a time."""
        while len(maps) > 1:
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def normalised(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no special case for a final sigma

    def count(self, text: str, chunk: int | None = None) -> int:
        if self.special is not None and any(m in text for m in self.marks) and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count(p, chunk) for p in parts if p)
        if len(self.states) > STATES:
            self.reset()
        text, size = self.normalised(text), chunk or CHUNK
        if not text:
            return 0
        state, total = self.scan([self.chunk(text[i : i + size]) for i in range(0, len(text), size)]).at(self.start)
        return total + state.last


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def _count(path: str, limit: int, batch) -> dict:
    machine = transducer(path)
    texts = [t or "" for t in batch.column(1).to_pylist()]
    tokens = [machine.count(t) for t in texts]
    return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text). No shuffle."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(docs, partial(_count, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
