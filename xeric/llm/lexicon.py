"""A minimal acyclic transducer from words to id sequences, laid out for memory-mapping."""

from __future__ import annotations

import numpy as np

MAGIC = b"XLEX0001"


class _State:
    __slots__ = ("final", "arcs", "number")

    def __init__(self) -> None:
        self.final, self.arcs, self.number = False, {}, -1

    def signature(self) -> tuple:
        return self.final, tuple((b, s.number) for b, s in self.arcs.items())


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes: a minimal automaton over the words, whose arcs' outputs add up to the word's place in order.

    Words are added in sorted order; a state is compared with those finished as soon as no later word can change it, so
    words share suffixes as well as prefixes (Daciuk et al., 2000). An arc's output is the number of words that leave
    its state by smaller bytes or end there; their sum along a path is the word's rank, which finds its ids. Arcs are
    packed into one array by displacement: the arc of state s with byte b is at base[s] + b, if owner there is s.
    """
    words = sorted(w for w in entries if w)
    root, register, finished = _State(), {}, []
    path, previous = [root], b""

    def close(depth: int) -> None:
        for d in range(len(path) - 1, depth, -1):
            state, parent, byte = path[d], path[d - 1], previous[d - 1]
            same = register.setdefault(state.signature(), state)
            if same is state:
                state.number = len(finished)
                finished.append(state)
            parent.arcs[byte] = same
        del path[depth + 1 :]

    for word in words:
        shared = 0
        while shared < min(len(word), len(previous)) and word[shared] == previous[shared]:
            shared += 1
        close(shared)
        for b in word[shared:]:
            new = _State()
            path[-1].arcs[b] = new
            path.append(new)
        path[-1].final, previous = True, word
    close(0)
    root.number = len(finished)
    finished.append(root)

    below = np.zeros(len(finished), np.int64)  # words from a state on; children are finished first
    for s in finished:
        below[s.number] = s.final + sum(below[c.number] for c in s.arcs.values())
    base = np.zeros(len(finished), np.int32)
    room = 256 + 2 * sum(len(s.arcs) for s in finished) + 1024
    owner, target, output = np.full(room, -1, np.int32), np.zeros(room, np.int32), np.zeros(room, np.int32)
    hint, window, width = 0, 2048, 257
    for s in sorted(finished, key=lambda s: -len(s.arcs)):
        if not s.arcs:
            break
        labels = sorted(s.arcs)
        while True:
            if hint + window + 512 > room:
                owner, target, output = (np.append(x, np.full(room, fill, np.int32)) for x, fill in ((owner, -1), (target, 0), (output, 0)))
                room *= 2
            fits = np.ones(window, bool)
            for b in labels:
                fits &= owner[hint + b : hint + b + window] < 0
            at = int(fits.argmax())
            if fits[at]:
                break
            hint += window
        # The next search begins where this one ended: gaps left behind are filled by states of fewer arcs.
        at += hint
        if len(labels) < width:
            width, hint = len(labels), 0
        elif at - hint > window // 2:
            hint = at
        base[s.number] = at
        before = int(s.final)
        for b in labels:
            child = s.arcs[b]
            owner[at + b], target[at + b], output[at + b] = s.number, child.number, before
            before += int(below[child.number])
    final = np.array([s.final for s in finished], np.int32)
    ends = np.cumsum([0] + [len(entries[w]) for w in words]).astype(np.int32)
    ids = np.array([i for w in words for i in entries[w]], np.int32)
    parts = [base, final, owner, target, output, ends, ids]
    head = np.array([root.number, *map(len, parts)], np.int64)
    return MAGIC + head.tobytes() + b"".join(np.ascontiguousarray(p, np.int32).tobytes() for p in parts)


class Lexicon:
    """Look words up in a compiled file that is memory-mapped, all words of a batch a byte at a time."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{path}: not a lexicon")
            head = np.frombuffer(f.read(64), np.int64)
        self.root, at, parts = int(head[0]), 72, []
        for n in head[1:].tolist():
            parts.append(np.memmap(path, np.int32, "r", at, (n,)) if n else np.zeros(0, np.int32))
            at += 4 * n
        self.base, self.final, self.owner, self.target, self.output, self.ends, self.ids = parts

    def __len__(self) -> int:
        return len(self.ends) - 1

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word data[start : start + length], -1 for those that are not in the lexicon."""
        n = len(starts)
        found = np.full(n, -1, np.int64)
        order = np.argsort(-lengths, kind="stable")
        state, rank = np.full(n, self.root, np.int32), np.zeros(n, np.int64)
        who, starts, lengths = order, starts[order], lengths[order]
        depth = 0
        while len(who):
            going = int(np.searchsorted(-lengths, -depth, side="left"))  # those longer than depth
            ended = np.arange(going, len(who))
            ok = ended[self.final[state[ended]] > 0]
            found[who[ok]] = rank[ok]
            who, starts, lengths, state, rank = who[:going], starts[:going], lengths[:going], state[:going], rank[:going]
            if not going:
                break
            arc = self.base[state] + data[starts + depth]
            on = self.owner[arc] == state
            arc = arc[on]
            who, starts, lengths = who[on], starts[on], lengths[on]
            state, rank = self.target[arc], rank[on] + self.output[arc]
            depth += 1
        return found
