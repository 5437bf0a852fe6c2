"""Plain, slow versions of the operators, over lists of rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(SMALL))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(texts: list[str | None], size: int, percent: int = 80) -> list[int]:
    """For each text the number of the first text it is linked to by a chain."""
    sets = [shingles(text, size) for text in texts]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            common = len(one & sets[j])
            if common and 100 * common >= percent * (len(one) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(sets))]


def contaminated(text: str | None, items: list[tuple], size: int = 10) -> tuple[int, int, list[str]]:
    """Words, hit words and items of a text."""
    words, hit, found = TERM.findall((text or "").translate(SMALL)), set(), set()
    for item_id, item in items:
        own = TERM.findall((item or "").translate(SMALL))
        for k in range(max(1, len(own) - size + 1) if own else 0):
            window = own[k : k + size]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(item_id)
    return len(words), len(hit), sorted(str(i) for i in found if i is not None)


def _luhn(digits: str) -> bool:
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def entities(text: str | None) -> list[tuple[int, int, str, int]]:
    def valid(kind: str, value: str) -> bool:
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(part) <= 255 for part in value.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and _luhn(digits)
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted(
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    )


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered, seen, repeated = Counter(triples), set(), set(), 0
    for i, triple in enumerate(triples):
        if often[triple] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), repeated, len(covered)


def apart(a: tuple, b: tuple) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def dropped_lines(texts: list[str | None], least: int) -> list[tuple[int, list[int]]]:
    """Lines and superfluous line numbers of each text, the texts being in order."""
    seen, out = [], []
    for text in texts:
        count, gone = 0, []
        for number, line in enumerate((text or "").split("\n")):
            words = tuple(WORD.findall(line.translate(SMALL)))
            if words:
                count += 1
                if any(words == o or (min(len(words), len(o)) >= least and apart(words, o)) for o in seen):
                    gone.append(number)
                seen.append(words)
        out.append((count, gone))
    return out


def token_rows(rows: list[tuple], encode) -> list[tuple]:
    """(doc_id, start, n_tokens, crc32) of rows (doc_id, text) in file order."""
    out, at = [], 0
    for doc_id, text in rows:
        ids = encode(text or "") + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def mix_targets(sizes: dict, share: float = 1.5) -> dict:
    """Each source's target, by handing the excess on until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {source: (3, 1, 2)[k % 3] for k, source in enumerate(order)}
    full, rest = set(), share * sum(sizes.values())
    while True:
        left = [s for s in order if s not in full]
        level = (rest - sum(2.0 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in left))
        over = {s for s in left if level * weight[s] > 2.0 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def grouped(pairs) -> dict:
    out = defaultdict(list)
    for key, value in pairs:
        out[key].append(value)
    return out
