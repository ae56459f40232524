"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def spaced_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def quality_base(text: str | None) -> dict:
    text = text or ""
    words = spaced_words(text)
    lines = [x for x in text.split("\n") if spaced_words(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
        "base_failed": n < 20 or 100 * len(hit) > 30 * n,
    }


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of (doc_id, text) and (item_id, text)."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = bench_words(text)
        size = min(10, len(words))
        for i in range(len(words) - size + 1) if words else ():
            windows.setdefault(tuple(words[i : i + size]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = bench_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (met := windows.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= met
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def simhash(text: str | None) -> int:
    words = spaced_words((text or "").translate(UPPER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def simhash_components(docs: list[tuple], radius: int = 2) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of (doc_id, text)."""
    prints = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(d, f"{p:016x}", least.get(root(i))) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))]


BASE = {
    "assign": r"(?a:(?i:(password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def base_secrets(text: str | None) -> list[tuple[int, int, str]]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2])))


def repeated_bytes(texts: list[str | None], length: int = 200) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d) + 1)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not gone[i + 1] for i in range(len(d)))
        kept = bytes(b for i, b in enumerate(d) if not gone[i])
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
