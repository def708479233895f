"""Plain versions of the operators, and awkward documents."""

import hashlib
import itertools
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(seed=1, n=60):
    """(doc_id, text, lang, source, n_chars, id, body, key): copies, near copies, shared lines, nulls, long and odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    common = [line(12) for _ in range(3)]
    texts = []
    for i in range(n):
        lines = [line(r.randint(3, 25)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(r.randint(0, len(lines)), ("  " + common[i % 3].upper() + "\t") if i % 2 else common[i % 3])
        texts.append("\n".join(lines))
    for i in range(0, 20, 2):  # near copies in a chain
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[1], None, None, "", "", " \n\t ", "one", "two words", "é É ß ǅ 日本語 🎉 <|endoftext|> it's", "\n\n\n", "a" * 3000, ("x y " * 4000), common[0] + "\n" + common[0], "  " + common[1] + " \u0085"]
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 9 else None, len(t or ""), "clash", "clash", i) for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, key int"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def near_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), c) for (i, s), c in zip(sets.items(), components(sets, links).values(), strict=True)}


def drop_lines(rows, least=5, chars=40):
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= least and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = budget * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: float(most * sizes[s]) for s in over}
