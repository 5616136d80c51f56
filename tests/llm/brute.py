"""Brute-force versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict


def shingle_set(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(rows, size, percent):
    """[(doc_id, set size, component)] of rows (doc_id, text)."""
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def without_repeated_lines(rows, min_chars):
    """[(doc_id, text, lines removed)] of rows (doc_id, text), whose ids differ: a chunk goes from a solid line to the first that fills it, forwards or backwards."""
    chunks = defaultdict(list)
    split = [None if t is None else t.split("\n") for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        lines = split[i] or []
        solid = [k for k, x in enumerate(lines) if re.search(r"[^ \t\n\x0b\f\r]", x)]
        spans = set()
        for step in (1, -1):
            for a in range(len(solid)):
                b, chars = a, len(lines[solid[a]])
                while 0 <= b < len(solid) and (b == a or chars < min_chars):
                    b += step
                    chars += len(lines[solid[b]]) if 0 <= b < len(solid) else 0
                if 0 <= b < len(solid):
                    spans.add((solid[min(a, b)], solid[max(a, b)] + 1))
        for first, stop in sorted(spans):
            chunks["\n".join(lines[first:stop])].append((i, first, stop))
    gone = defaultdict(set)
    for places in chunks.values():
        for i, first, stop in places[1:]:
            gone[i].update(range(first, stop))
    found = []
    for i, (doc_id, text) in enumerate(rows):
        left = [x for k, x in enumerate(split[i] or []) if k not in gone[i]]
        emptied = gone[i] and not any(re.search(r"[^ \t\n\x0b\f\r]", x) for x in left)
        found.append((doc_id, text if not gone[i] else "" if emptied else "\n".join(left), len(split[i]) if emptied else len(gone[i])))
    return found


def plain_copy(text, item, common=frozenset()):
    """Whether a text holds enough of an item's windows of words about one diagonal, and of its words' weight; both in lower case and without marks."""
    a, b = text.split(), item.split()
    length, share, content = (8, 0.4, 0.4) if len(b) >= 32 else (4, 0.5, 0.5) if len(b) >= 16 else (3, 0.5, 0.7) if len(b) >= 8 else (len(b), 1.0, 0.7)
    hits = {(i - j, j) for j in range(len(b) - length + 1) for i in range(len(a) - length + 1) if a[i : i + length] == b[j : j + length]}
    weight = lambda places: sum(0.1 if b[k] in common else 1.0 for k in places)
    for shift in (0, 8):
        for band in {(d + shift) // 16 for d, _ in hits}:
            near = [(d, j) for d, j in hits if (d + shift) // 16 == band]
            starts = {j for _, j in near}
            covered = {k for j in starts for k in range(j, j + length)}
            if len(starts) >= share * (len(b) - length + 1) and weight(covered) >= content * weight(range(len(b))) - 1e-9:
                return True
            if length == 8 and max(Counter(d for d, _ in near).values()) >= 6 and sum(b[k] not in common for k in covered) >= 4:
                return True
    return False


def paragraphs(text):
    """Lines; a longer one is cut after the first word from number 25 on that ends a sentence, or after 40."""
    found = set()
    for line in (text or "").split("\n"):
        piece = []
        for word in re.findall(r"\S+[ \t]*", line.lstrip(" \t")):
            piece.append(word)
            if len(piece) > 24 and (word.rstrip(" \t")[-1] in ".!?" or len(piece) == 40):
                found.add("".join(piece))
                piece = []
        if piece:
            found.add("".join(piece))
    return found


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def repeated_passages(rows, size=50):
    """[(row number, start, end, class)] of runs of words in which every `size` stand in another row too; runs that share such words are of one class, named by the number of its first run."""
    at = defaultdict(list)
    split = [(t or "").encode().split() for _, t in rows]
    for i, words in enumerate(split):
        for k in range(len(words) - size + 1):
            at[tuple(words[k : k + size])].append((i, k))
    shared = [places for places in at.values() if len({i for i, _ in places}) > 1]
    covered = defaultdict(set)
    for places in shared:
        for i, k in places:
            covered[i].update(range(k, k + size))
    runs, run_of = [], {}
    for i, words in sorted(covered.items()):
        for k in sorted(words):
            if k - 1 not in words:
                runs.append([i, k, k])
            runs[-1][2] = k + 1
            run_of[i, k] = len(runs) - 1
    root = list(range(len(runs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for places in shared:
        for place in places:
            a, b = find(run_of[place]), find(run_of[places[0]])
            root[max(a, b)] = min(a, b)
    return [(i, a, b, find(n)) for n, (i, a, b) in enumerate(runs)]


def counted(rows):
    return Counter(map(tuple, rows))
